"""Secrets in text: a character convolutional network over every candidate and its surrounding context.

A candidate is a run of at least 12 of ``A-Za-z0-9_+/-`` with a letter and a digit, or the inside of a PEM private key. The network
sees its characters and those around it: an embedding of each byte together with its role (before, within or after), a
convolution, the maximum over all places, and a hidden layer. It is written in numpy and trained on labelled findings, which are
made here from public key formats and from look-alikes (digests, ids, versions, long words). The score is calibrated on findings held out, and
the threshold is the greatest that keeps the wanted recall there.
"""

from __future__ import annotations

import functools
import re
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .shared import lean
from .textblock import buffers

LEAST, BEFORE, WITHIN, AFTER = 12, 32, 64, 8
WINDOW = BEFORE + WITHIN + AFTER
SYMBOLS = 128
MASK = "[SECRET]"
_CLASS = np.zeros(256, np.uint8)  # 1: letter, 2: digit, 3: other character of a token
for _c in string.ascii_letters:
    _CLASS[ord(_c)] = 1
for _c in string.digits:
    _CLASS[ord(_c)] = 2
for _c in "_+/-":
    _CLASS[ord(_c)] = 3
_PEM = re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", re.S)


def candidates(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all candidates, which don't reach over a text's end. data: the texts one after another, at: their offsets."""
    kind = np.append(_CLASS[data], 0)
    token = kind > 0
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    before = np.append(False, token[:-1])
    starts, ends = np.flatnonzero(token & (~before | first)), np.flatnonzero(before & (~token | first))
    long = ends - starts >= LEAST
    starts, ends = starts[long], ends[long]
    has = lambda k: np.append(0, np.cumsum(kind == k))
    for k in (1, 2):
        n = has(k)
        ok = n[ends] > n[starts]
        starts, ends = starts[ok], ends[ok]
    raw = None
    if (data == ord("-")).any() and b"PRIVATE KEY-----" in (raw := data.tobytes()):
        spans = []
        for a, b in zip(at[:-1], at[1:]):
            spans += [(a + m.start(), a + m.end()) for m in _PEM.finditer(raw[a:b])]
        if spans:
            s, e = np.array(spans).T
            inside = np.searchsorted(s, starts, side="right") - 1
            free = (inside < 0) | (starts >= e[np.maximum(inside, 0)])
            starts, ends = np.concatenate([starts[free], s]), np.concatenate([ends[free], e])
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], ends[order]
    return starts, ends


def encode(data: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The network's windows, and the candidate of each. A candidate longer than a window has several, so all of it is seen."""
    pieces = np.maximum(1, -(-(ends - starts) // WITHIN))
    owner = np.repeat(np.arange(len(starts)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = starts[owner] + nth * WITHIN
    text = np.searchsorted(at, starts[owner], side="right") - 1
    place = begin[:, None] + np.arange(-BEFORE, WITHIN + AFTER)
    inside = (place >= at[text][:, None]) & (place < at[text + 1][:, None])
    symbol = data[np.clip(place, 0, max(len(data) - 1, 0))] if len(data) else np.zeros(place.shape, np.uint8)
    symbol = np.minimum(symbol, SYMBOLS - 1).astype(np.int64)
    within = (place >= starts[owner][:, None]) & (place < ends[owner][:, None])
    role = np.where(within, 1, np.where(place < starts[owner][:, None], 0, 2))
    # what is further after the candidate than AFTER isn't context
    inside &= place < (ends[owner] + AFTER)[:, None]
    return np.where(inside, 1 + role * SYMBOLS + symbol, 0), owner


@dataclass
class Network:
    embedding: np.ndarray  # (1 + 3 * SYMBOLS) x d; row 0 is padding
    filters: np.ndarray  # width * d x f
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    width: int = 5
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[0]

    def _forward(self, x: np.ndarray) -> tuple:
        e = self.embedding[x]
        n, length, d = e.shape
        columns = np.lib.stride_tricks.sliding_window_view(e, self.width, axis=1).transpose(0, 1, 3, 2).reshape(n * (length - self.width + 1), self.width * d)
        conv = (columns @ self.filters).reshape(n, length - self.width + 1, -1)
        best = conv.argmax(1)
        top = np.take_along_axis(conv, best[:, None, :], 1)[:, 0] + self.bias
        pooled = np.maximum(top, 0)
        h = pooled @ self.hidden + self.hidden_bias
        active = np.maximum(h, 0)
        return (active @ self.out + self.out_bias)[:, 0], columns, best, top, pooled, h, active

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        out = np.empty(len(x))
        for lo in range(0, len(x), 512):
            out[lo : lo + 512] = 1 / (1 + np.exp(-(self.slope * self.logits(x[lo : lo + 512]) + self.offset)))
        return out


def labelled_findings(n: int, seed: int) -> list[tuple[str, str, str, int]]:
    """(before, candidate, after, is a secret): half of them secrets, each with a context of words."""
    r = np.random.default_rng(seed)
    pick = lambda alphabet, k: "".join(alphabet[i] for i in r.integers(0, len(alphabet), k))
    lower, upper, digits, hexa = string.ascii_lowercase, string.ascii_uppercase, string.digits, "0123456789abcdef"
    alnum = string.ascii_letters + digits
    one = lambda *options: options[r.integers(0, len(options))]
    word = lambda: pick("etaoinshrdlu" + lower, int(r.integers(2, 10)))

    def secret() -> tuple[str, str, str]:
        name = one("token", "password", "passwd", "pwd", "secret", "api_key", "apikey", "access_key", "auth", "client_secret", "TOKEN", "SECRET_KEY", "Password")
        link = one("=", " = ", ": ", ":", '="', ' = "', "='", '": "')
        value = one(pick(hexa, int(one(16, 18, 20, 24, 32, 40, 48, 64))), pick(alnum, int(r.integers(12, 48))), pick(alnum + "+/", int(r.integers(16, 64))), pick(alnum + "-_", int(r.integers(16, 48))))
        kind = r.integers(0, 10)
        if kind < 6:
            return name + link, value, '"' if '"' in link else ""
        return "", one("AKIA" + pick(upper + digits, 16), "ASIA" + pick(upper + digits, 16), "ghp_" + pick(alnum, 36), "sk_live_" + pick(alnum, 24), "glpat-" + pick(alnum, 20), "xoxb-" + pick(digits, 12) + "-" + pick(alnum, 24), "eyJ" + pick(alnum, 40), "AIza" + pick(alnum + "-_", 35)), ""

    def other() -> tuple[str, str, str]:
        kind = r.integers(0, 9)
        if kind == 0:
            return one("sha1 ", "sha256:", "md5 ", "checksum ", "commit ", "digest: ", "etag "), pick(hexa, int(one(32, 40, 64))), ""
        if kind == 1:
            return one("id ", "uuid=", "", "order "), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), ""
        if kind == 2:
            return "", word() + word() + word() + pick(digits, int(r.integers(1, 4))), ""
        if kind == 3:
            return "", "-".join([word(), word(), word(), pick(digits, int(r.integers(1, 5)))]), ""
        if kind == 4:
            return one("", "invoice ", "ref "), one("INV-", "ORD-", "SKU-", "REF-") + pick(digits, 4) + "-" + pick(digits, 6) + one("", "-A", "-EU"), ""
        if kind == 5:
            return "/", "/".join([word(), word(), word() + pick(digits, 2), word()]), one(".html", ".png", "")
        if kind == 6:
            return "", "_".join([word(), word(), pick(digits, int(r.integers(1, 4))), word()]), ""
        if kind == 7:
            return "", pick(digits, 4) + "-" + pick(digits, 2) + "-" + pick(digits, 2) + "T" + pick(digits, 2), ":00"
        return one("version ", "v", ""), one("release-", "build-", "python-") + pick(digits, 2) + "-" + word() + pick(digits, 1), ""

    out = []
    for i in range(n):
        a, c, b = secret() if i % 2 else other()
        if len(c) < LEAST:
            c += pick(lower, LEAST - len(c))
        noise = one("", "", "", "###", "$$$", "%%%", "&&&", "***", "!!", ",", ".", ";")
        out.append((" ".join(word() for _ in range(int(r.integers(0, 9)))) + one(" ", "\n") + a, c, b + noise + " " + " ".join(word() for _ in range(int(r.integers(0, 3)))), i % 2))
    return out


def encoded_findings(findings: list[tuple[str, str, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    texts = [a + c + b for a, c, b, _ in findings]
    data, at = buffers(pa.array(texts))
    starts = at[:-1] + np.array([len(a) for a, *_ in findings])
    x, owner = encode(data, at, starts, starts + np.array([len(f[1]) for f in findings]))
    return x, np.array([f[3] for f in findings])[owner]


@functools.lru_cache(maxsize=4)
def trained(n: int = 6000, recall: float = 0.99, seed: int = 7, epochs: int = 8, dim: int = 8, n_filters: int = 32, n_hidden: int = 16) -> Network:
    """Adam on the logistic loss over n findings; Platt scaling and the threshold on a third as many others."""
    r = np.random.default_rng(seed)
    width = 5
    net = Network(r.normal(0, 0.3, (1 + 3 * SYMBOLS, dim)), r.normal(0, (width * dim) ** -0.5, (width * dim, n_filters)), np.zeros(n_filters), r.normal(0, n_filters**-0.5, (n_filters, n_hidden)), np.zeros(n_hidden), r.normal(0, n_hidden**-0.5, (n_hidden, 1)), np.zeros(1), width)
    net.embedding[0] = 0
    x, y = encoded_findings(labelled_findings(n, seed))
    names = ("embedding", "filters", "bias", "hidden", "hidden_bias", "out", "out_bias")
    first, second, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(epochs):
        order = r.permutation(len(x))
        for lo in range(0, len(x), 64):
            i = order[lo : lo + 64]
            g = _gradients(net, x[i], y[i])
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                setattr(net, k, getattr(net, k) - 0.004 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
            net.embedding[0] = 0
    x, y = encoded_findings(labelled_findings(max(300, n // 3), seed + 1))
    z = np.concatenate([net.logits(x[lo : lo + 512]) for lo in range(0, len(x), 512)])
    slope, offset = 1.0, 0.0
    for _ in range(200):  # Newton's method on two parameters
        p = 1 / (1 + np.exp(-(slope * z + offset)))
        w = p * (1 - p) + 1e-6
        g = np.array([((y - p) * z).sum() - 1e-3 * slope, (y - p).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum()]])
        d = np.linalg.solve(h, g)
        slope, offset = slope + np.clip(d[0], -1, 1), offset + np.clip(d[1], -1, 1)
    net.slope, net.offset = float(slope), float(offset)
    s = np.sort(net.scores(x[y == 1]))
    net.threshold = float(min(s[int(np.floor((1 - recall) * len(s)))], 0.5))
    for k in names:  # scoring takes half the time in single precision
        setattr(net, k, getattr(net, k).astype(np.float32))
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    z, columns, best, top, pooled, h, active = net._forward(x)
    n, f = top.shape
    dz = ((1 / (1 + np.exp(-z))) - y)[:, None] / n
    dh = dz @ net.out.T * (h > 0)
    dtop = dh @ net.hidden.T * (top > 0)
    length = len(columns) // n
    row = (np.arange(n)[:, None] * length + best).ravel()
    picked = columns[row].reshape(n, f, -1)
    dcolumns = dtop[:, :, None] * net.filters.T[None]
    dembedding = np.zeros_like(net.embedding)
    place = best[:, :, None] + np.arange(net.width)
    symbol = x[np.arange(n)[:, None, None], place]
    np.add.at(dembedding, symbol.ravel(), dcolumns.reshape(n * f * net.width, -1))
    dembedding[0] = 0
    return {"embedding": dembedding, "filters": np.einsum("nf,nfk->kf", dtop, picked), "bias": dtop.sum(0), "hidden": pooled.T @ dh, "hidden_bias": dh.sum(0), "out": active.T @ dz, "out_bias": dz.sum(0)}


def found(column: pa.Array, net: Network) -> tuple[np.ndarray, ...]:
    """text, start and end (bytes within all), score of each finding; the texts' bytes and their offsets."""
    data, at = buffers(column)
    starts, ends = candidates(data, at)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0), data, at
    score = np.zeros(len(starts))
    lo = 0
    while lo < len(starts):  # whole candidates, about 4096 windows at a time
        hi = min(len(starts), lo + max(1, int(np.searchsorted(np.cumsum(1 + (ends[lo : lo + 4096] - starts[lo : lo + 4096]) // WITHIN), 4096))))
        x, owner = encode(data, at, starts[lo:hi], ends[lo:hi])
        np.maximum.at(score, owner + lo, net.scores(x))
        lo = hi
    yes = score >= net.threshold
    text = np.searchsorted(at, starts, side="right") - 1
    return text[yes], starts[yes], ends[yes], score[yes], data, at


def _slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
        at = np.frombuffer(size.buffers()[1], np.int64)[size.offset : size.offset + len(size) + 1]
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _scan(net: Network) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "text"):
            text, start, end, score, data, at = found(batch.column(batch.schema.get_field_index("text")), net)
            if not len(text):
                continue
            characters = np.append(0, np.cumsum((data & 0xC0) != 0x80))
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(text)), pa.array((characters[start] - characters[at[text]]).astype(np.int64)), pa.array((characters[end] - characters[at[text]]).astype(np.int64)), pa.array(np.round(score, 6))], ["doc_id", "start_char", "end_char", "score"])

    return run


def secret_scan(docs: DataFrame, recall: float = 0.99, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, start_char, end_char (exclusive), score: every finding in every text, but not the secret itself.

    ``recall`` is that of the threshold on held-out labelled findings. Null and empty texts have no findings; findings of rows
    with a null id have a null id; repeated rows have theirs each. Other columns are ignored, whatever their names. An empty
    table gives no rows. Texts and candidates of any length are read whole.
    """
    lean(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan(trained(recall=recall)), "doc_id long, start_char long, end_char long, score double")


def redacted(docs: DataFrame, recall: float = 0.99, text_col: str = "text", length_col: str | None = "n_chars", mask: str = MASK) -> DataFrame:
    """The rows of ``docs`` with each secret (see secret_scan) replaced by ``mask``, and their length put right in ``length_col``; all else is as it was.

    Null and empty texts, rows without an id and repeated rows stay as they are, with their secrets masked. The length is put right
    where the text changes, if ``length_col`` is an integer column; of another type it stays. Other columns may have any names and types. An empty table
    gives none. Texts of any length are read whole.
    """
    lean(docs.sparkSession)
    net = trained(recall=recall)
    name = length_col if length_col in docs.columns and isinstance(docs.schema[length_col].dataType, IntegralType) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, text_col):
            i = batch.schema.get_field_index(text_col)
            text, start, end, _, data, at = found(batch.column(i), net)
            if len(text):
                values = batch.column(i).to_pylist()
                sizes = batch.column(batch.schema.get_field_index(name)).to_pylist() if name else None
                for t, spans in pd.DataFrame({"t": text, "s": start, "e": end}).groupby("t"):
                    raw, out, last = data[at[t] : at[t + 1]].tobytes(), [], 0
                    for s, e in zip(spans["s"] - at[t], spans["e"] - at[t]):
                        out += [raw[last:s], mask.encode()]
                        last = e
                    values[t] = (b"".join(out) + raw[last:]).decode()
                    if sizes:
                        sizes[t] = len(values[t])
                batch = batch.set_column(i, batch.schema.field(i), pa.array(values, batch.schema.field(i).type))
                if sizes:
                    j = batch.schema.get_field_index(name)
                    batch = batch.set_column(j, batch.schema.field(j), pa.array(sizes, batch.schema.field(j).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
