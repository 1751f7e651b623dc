"""Definitions in XML files: chunks with semantic titles, and references to classes, components and other definitions."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from xml.parsers import expat

from ..functions.text import CLASS_PREFIXES, CLASS_SUFFIXES, DEFAULT_NAMESPACE, NAMESPACE_RULES

#: elements that hold a class: those looked for among a definition's children, and those looked for anywhere in it
CHILD_CLASS_FIELDS = ("aiController", "class", "driverClass", "hediffClass", "roomContentsWorkerType", "thingClass", "workerClass")
CLASS_FIELDS = sorted({*CHILD_CLASS_FIELDS, "abilityClass", "behaviorWorker", "compClass", "graphicClass", "interactionWorker", "jobDriver", "outcomeEffect", "placeWorkers", "relationWorker", "thoughtWorker", "verbClass"})
SHOWN_STATS = {"ArmorRating_Blunt", "ArmorRating_Sharp", "Beauty", "DoorOpenSpeed", "Flammability", "MarketValue", "Mass", "MaxHitPoints", "MoveSpeed", "WorkTableWorkSpeedFactor", "WorkToBuild"}


def local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def value(e: ET.Element | None) -> str | None:
    """All text within an element; null without one."""
    return None if e is None else "".join(e.itertext())


def children(e: ET.Element | None) -> list[ET.Element]:
    return [] if e is None else [c for c in e if isinstance(c.tag, str)]


def child(e: ET.Element, *names: str) -> ET.Element | None:
    return next((c for n in names for c in children(e) if local(c) == n), None)


def below(e: ET.Element, name: str) -> list[ET.Element]:
    return [d for d in e.iter() if d is not e and local(d) == name]


def blank(s: str | None) -> bool:
    return not s or not s.strip()


def probe(e: ET.Element, *names: str) -> str | None:
    """For each name a child, an attribute, else the first descendant; the first value that isn't blank."""
    for n in names:
        for v in (value(child(e, n)), e.get(n), value(next(iter(below(e, n)), None))):
            if not blank(v):
                return v.strip()
    return None


def looks_like_class(v: str) -> bool:
    if blank(v) or re.search(r"[ \n<>]", v) or v.lower() in ("true", "false") or re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v):
        return False
    if not (v[0].isalpha() or v[0] == "_"):
        return False
    return "." in v or v.startswith(tuple(CLASS_PREFIXES)) or v.endswith(tuple(CLASS_SUFFIXES)) or (v[0].isupper() and len(v) > 2)


def qualified(name: str, rules: Iterable[tuple[str, str]] = NAMESPACE_RULES, default: str = DEFAULT_NAMESPACE) -> str:
    if "." in name:
        return name
    return f"{next((ns for p, ns in rules if name.startswith(p)), default)}.{name}"


def plain(component: str) -> str:
    return component.replace("CompProperties_", "").replace("Comp_", "")


def title(e: ET.Element, def_type: str, name: str, parent: str | None) -> str:
    """A few lines that say what a definition is: common fields, then those of its type."""
    lines = [f"{def_type}: {name}" + (f" (inherits {parent})" if parent else "")]
    add = lambda label, v: lines.append(f"{label}: {v}") if not blank(v) else None
    join = lambda label, vs: lines.append(f"{label}: {', '.join(vs)}") if vs else None
    times = lambda es, n: [f"{local(c)}×{value(c)}" for c in es][:n]
    add("Label", probe(e, "label"))
    about = probe(e, "description")
    add("Description", about if about is None or len(about) <= 150 else about[:147] + "...")
    add("Class", probe(e, *"thingClass class workerClass hediffClass".split()))
    if def_type == "ThingDef":
        add("Category", probe(e, "designationCategory"))
        join("Stats", [f"{local(s)}={value(s)}" for s in children(child(e, "statBases")) if local(s) in SHOWN_STATS][:4])
        join("Comps", [plain(c.get("Class")) for c in children(child(e, "comps")) if c.get("Class")][:4])
        join("Cost", times(children(child(e, "costList")), 3))
    elif def_type == "RecipeDef":
        join("Workbenches", [value(c) for c in children(child(e, "recipeUsers"))][:3])
        join("Products", times(children(child(e, "products")), 3))
        made_of = []
        for i in children(child(e, "ingredients")):
            kinds, count = child(i, "filter"), value(child(i, "count")) or "?"
            names = [] if kinds is None else children(child(kinds, "thingDefs")) or children(child(kinds, "categories"))
            made_of += [f"{value(c)}×{count}" for c in names]
        join("Ingredients", made_of[:3])
        add("WorkAmount", probe(e, "workAmount"))
    elif def_type == "HediffDef":
        if (probe(e, "tendable") or "") in ("true", "True"):
            lines.append("Tendable: Yes")
        add("MaxSeverity", probe(e, "maxSeverity"))
        stages = children(child(e, "stages"))
        if stages:
            lines.append(f"Stages: {len(stages)}")
            for i in sorted({0, len(stages) - 1}):
                add(f"Stage {i + 1}", stage_effects(stages[i]))
        add("Lethal at severity", probe(e, "lethalSeverity"))
    elif def_type == "PawnKindDef":
        add("Race", probe(e, "race"))
        add("CombatPower", probe(e, "combatPower"))
        join("Weapons", list(dict.fromkeys(value(c) for t in below(e, "weaponTags") for c in children(t)))[:3])
    elif def_type == "GeneDef":
        add("Metabolic", probe(e, "biostatMet"))
        join("Effects", [f"{local(s)} {value(s)}" for s in children(child(e, "statOffsets"))][:3])
        add("Prerequisite", probe(e, "prerequisite"))
    return "\n".join(lines)


def stage_effects(stage: ET.Element) -> str | None:
    out = []
    if (pain := child(stage, "painFactor", "painOffset")) is not None:
        out.append(f"pain {value(pain)}")
    if (c := child(stage, "consciousnessFactor")) is not None:
        out.append(f"consciousness ×{value(c)}")
    pairs = [(value(child(m, "capacity")), value(child(m, "offset"))) for m in children(child(stage, "capMods"))]
    out += [f"{a} {b}" for a, b in pairs if a and b][:2]
    return ", ".join(out) or None


def references(e: ET.Element, def_type: str, parent: str | None, class_fields: Iterable[str] = CLASS_FIELDS, rules: Iterable[tuple[str, str]] = NAMESPACE_RULES, default: str = DEFAULT_NAMESPACE) -> Iterator[tuple[str, str]]:
    """(name, kind): classes bound (each once, in any case), components, the parent, and definitions named by the rules of the type."""
    fields = set(class_fields)
    bound = [value(c) for c in children(e) if local(c) in CHILD_CLASS_FIELDS]
    bound += [v for d in e.iter() if d is not e and local(d) in fields and looks_like_class(v := value(d).strip())]
    seen = set()
    for v in bound:
        if not blank(v) and (n := qualified(v.strip(), rules, default)).lower() not in seen:
            seen.add(n.lower())
            yield n, "XmlBindsClass"
    for comps in below(e, "comps"):
        for li in children(comps):
            if local(li) == "li" and not blank(li.get("Class")):
                yield qualified(li.get("Class").strip(), rules, default), "XmlUsesComp"
    if parent:
        yield parent, "XmlInherits"
    named: list[str | None] = []
    if def_type == "RecipeDef":
        named = [local(c) for p in below(e, "products") for c in children(p)] + [value(c) for i in below(e, "ingredients") for t in below(i, "thingDefs") for c in children(t)]
    elif def_type == "PawnKindDef":
        named = [value(child(e, "race"))]
    elif def_type == "ResearchProjectDef":
        named = [value(c) for p in below(e, "prerequisites") for c in children(p) if local(c) == "li"]
    elif def_type == "ThingDef":
        named = [local(c) for p in below(e, "costList") for c in children(p)]
    yield from ((n.strip(), "XmlReferences") for n in named if not blank(n))


def _lines(text: str) -> list[int]:
    """The line of each element below the root, in document order."""
    out, depth = [], 0
    parser = expat.ParserCreate()

    def start(*_):
        nonlocal depth
        depth += 1
        if depth == 2:
            out.append(parser.CurrentLineNumber)

    def end(*_):
        nonlocal depth
        depth -= 1

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.Parse(text.encode(), True)
    return out


def preview(text: str, limit: int) -> str:
    t = text.strip()
    return t if len(t) <= limit else t[:limit] + " …"


def parse(text: str, path: str = "", strict_compat: bool = False, **names) -> Iterator[tuple[dict, list[tuple[str, str]], str | None]]:
    """Chunk, references and alias (the Name attribute) of each definition. strict_compat keeps the run-together text of containers among the keywords."""
    text = text.lstrip("﻿")
    root = ET.fromstring(text)
    for e, line in zip(children(root), _lines(text)):
        def_type = local(e)
        name = value(child(e, "defName", "DefName"))
        if not def_type.lower().endswith("def") or blank(name):
            continue
        name = name.strip()
        cls = value(child(e, "class", "Class"))
        parent = next((p.strip() for p in (e.get("ParentName"), value(child(e, "ParentName")), value(child(e, "parentName")), value(child(e, "parent"))) if not blank(p)), None)
        e.tail = None
        raw = ET.tostring(e, encoding="unicode")
        flat = re.sub(r">\s+<", "><", raw)
        values = [v for d in e.iter() if d is not e and isinstance(d.tag, str) and (strict_compat or not children(d)) and not blank(v := value(d)) and len(v) < 200]
        words = [w.strip() for w in (name, cls, parent, *values) if not blank(w)]
        keywords = list({w.lower(): None for w in words})
        links = list({w.lower(): w for v in (*(value(d) for d in e.iter() if d is not e and isinstance(d.tag, str)), cls, parent) if v for w in re.split(r"[ \t\r\n,;]+", v) if w.lower().endswith("def")}.values())
        own = f"{def_type}:{name}" + (f" <- {parent}" if parent else "")
        head = title(e, def_type, name, parent)
        yield (
            dict(id=f"xml:{own}", path=path, lang="xml", text=flat, preview=f"{head}\n\n{preview(flat, 200)}", identifiers=None, keywords=keywords, symbol_kind="def", symbol_name=name, namespace="", containing_type="", span_start=0, span_end=len(flat), start_line=line, end_line=line + raw.count("\n"), signature=own, xml_links=links, def_type=def_type),
            list(references(e, def_type, parent, **names)),
            e.get("Name"),
        )
