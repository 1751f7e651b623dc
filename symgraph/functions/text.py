"""Text and identifier functions as column expressions: no Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAMEL = r"(?<!^)(?=[A-Z][a-z])|(?<=[a-z0-9])(?=[A-Z])"
#: the usual English stop words of lexical search
STOP_WORDS = sorted("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
#: what isn't a letter, digit, ``_`` or ``.``, with the dots beside it; and dots at the ends of the text
SEPARATORS = r"(?<!\.)\.*+[^\p{L}\p{N}_.][^\p{L}\p{N}_]*+|^\.+|\.+$"
CLASS_PREFIXES = ["AI", "Building", "Comp", "Gen", "Graphic", "Hediff", "Inc", "Job", "Pawn", "Place", "Quest", "Ritual", "Room", "Stat", "Thing", "Think", "Verb", "Work"]
CLASS_SUFFIXES = ["Class", "Comp", "Driver", "Effect", "Handler", "Worker"]
#: (prefix, namespace) rules for names without one, first match; then the default
NAMESPACE_RULES = [("Verb_", "Engine"), ("Graphic_", "Engine"), ("Hediff", "Engine"), ("ThinkNode", "Engine")]
DEFAULT_NAMESPACE = "Game"


def non_empty(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def split_identifier(name: Column, compat: bool = False) -> Column:
    """Lower-case words of an identifier, each followed by its camel-case parts if it has several. compat: lower-case first, so that none are found."""
    words = non_empty(F.split(F.regexp_replace(F.lower(name) if compat else name, r"[^A-Za-z0-9_.]", " "), " "))

    def parts(w: Column) -> Column:
        return F.concat(F.array(F.lower(w)), F.filter(F.transform(non_empty(F.split(w, CAMEL)), F.lower), lambda p: p != F.lower(w)))

    return F.flatten(F.transform(words, parts))


def split_identifiers(names: Column, compat: bool = False) -> Column:
    """Different words of several identifiers, in order."""
    return F.array_distinct(F.flatten(F.transform(names, lambda n: split_identifier(n, compat))))


def preview(text: Column, limit: int = 320) -> Column:
    """Trimmed; beyond the limit its beginning and an ellipsis."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit), F.lit(" …")))


def tokens(text: Column, stop_words: bool = True) -> Column:
    """Tokens of lexical search: lower case, letters, digits, ``_`` and ``.``; dots at the ends are dropped, and stop words by default."""
    words = F.split(F.lower(text), SEPARATORS)
    return F.filter(words, lambda w: ~w.isin("", *STOP_WORDS)) if stop_words else non_empty(words)


def identifier_tokens(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))


def looks_like_class(value: Column) -> Column:
    """Whether an element's text may be a class name: by its characters, known beginnings and ends, else by a capital and three letters."""
    v = F.coalesce(value, F.lit(""))
    bad = (F.trim(v) == "") | v.rlike(r"[ \n<>]") | F.try_to_number(v, F.lit("S999999999999D999999")).isNotNull() | v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") | F.lower(v).isin("true", "false") | ~v.rlike(r"^[\p{L}_]")
    known = v.rlike("^(" + "|".join(CLASS_PREFIXES) + ")") | v.rlike("(" + "|".join(CLASS_SUFFIXES) + ")$")
    return F.when(bad, False).when(v.contains("."), True).when(known, True).otherwise(v.rlike(r"^\p{Lu}") & (F.length(v) > 2))


def qualified_class(name: Column, rules: list[tuple[str, str]] | None = None, default: str = DEFAULT_NAMESPACE) -> Column:
    """A class name with a namespace: as it is if it has one, else by the first rule for its beginning."""
    out = F.when(name.contains("."), name)
    for prefix, namespace in NAMESPACE_RULES if rules is None else rules:
        out = out.when(name.startswith(prefix), F.concat(F.lit(f"{namespace}."), name))
    return out.otherwise(F.concat(F.lit(f"{default}."), name))


def plain_component(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("CompProperties_"), F.lit("")), F.lit("Comp_"), F.lit(""))


def def_links(value: Column) -> Column:
    """Words of a value that end in Def, in any case."""
    return F.filter(F.split(value, r"[ \t\r\n,;]+"), lambda w: F.lower(w).endswith("def"))


def short_values(values: Column, limit: int = 200) -> Column:
    return F.filter(values, lambda v: (F.trim(v) != "") & (F.length(v) < limit))


def embedding_text(text: Column, fallback: Column, mode: str = "passage") -> Column:
    """What an embedder gets: the text, or else the preview, after its mode."""
    if mode not in ("passage", "query"):
        raise ValueError("mode must be passage or query")
    body = F.coalesce(F.nullif(F.trim(text), F.lit("")), F.trim(fallback), F.lit(""))
    return F.trim(F.concat(F.lit(f"{mode}: "), body))


def signature(modifiers: Column, result: Column, name: Column, parameters: Column) -> Column:
    """``modifiers result name(parameters)`` of arrays of modifiers and parameters."""
    head = F.concat_ws(" ", F.array_join(modifiers, " "), result, name)
    return F.trim(F.concat(head, F.lit("("), F.array_join(parameters, ", "), F.lit(")")))


def symbol_id(namespace: Column, types: Column, own: Column) -> Column:
    """Namespace, containing types and the own name or signature, joined by dots; empty ones are left out."""
    return F.array_join(non_empty(F.filter(F.array(namespace, types, own), lambda x: x.isNotNull())), ".")


def context_preview(containing_type: Column, signature_: Column, text: Column, limit: int = 320) -> Column:
    prefix = F.when(F.coalesce(containing_type, F.lit("")) == "", signature_).otherwise(F.concat(containing_type, F.lit(" -> "), signature_))
    return F.concat(prefix, F.lit("\n"), preview(text, limit))


def symbol_kind(value: Column, known: tuple[str, ...]) -> Column:
    return F.when(F.lower(value).isin(*known), F.lower(value)).otherwise("unknown")


def head_lines(text: Column, max_lines: int) -> Column:
    """The first lines, all for 0."""
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, 1, max_lines), "\n") if max_lines else text


def text_slice(text: Column, start: Column, end: Column) -> Column:
    """Characters start..end-1, counted from 0; null where they aren't within the text."""
    ok = (start >= 0) & (end >= start) & (end <= F.length(text))
    return F.when(ok, F.substring(text, start + 1, end - start))
