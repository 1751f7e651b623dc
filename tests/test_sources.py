import struct
import textwrap

import pytest

from symgraph.sources import csharp, files, xml_defs

CODE = """namespace Demo.Core
{
    public class Door : Building, IOpenable
    {
        public const float OpenSpeed = 0.9f;
        public bool IsOpen { get; set; }
        public Door(int hp) { Init(hp); }
        public void Tick(int delta)
        {
            Helper.Log("x");
            var c = new Comp_Power();
            Init(delta);
        }
        private void Init(int hp) { }
    }
}
"""
DEFS = """<Defs>
  <ThingDef ParentName="BaseDoor">
    <defName>Door</defName>
    <label>door</label>
    <description>A simple door.</description>
    <thingClass>Building_Door</thingClass>
    <statBases><MaxHitPoints>160</MaxHitPoints><Beauty>0</Beauty><Nutrition>1</Nutrition></statBases>
    <costList><Steel>25</Steel></costList>
    <comps><li Class="CompProperties_Power"><x>1</x></li></comps>
  </ThingDef>
  <ThingDef><defName>Steel</defName></ThingDef>
  <ThingDef Name="BaseDoor" Abstract="True"><label>base</label></ThingDef>
</Defs>"""


def test_declarations():
    got = [(c["id"], c["symbol_kind"], c["signature"], c["span_start"], c["span_end"], c["start_line"], c["end_line"], c["keywords"]) for c, _, _ in csharp.parse(CODE)]
    d = "Demo.Core.Door"
    assert got == [
        (d, "type", "Door : Building", 26, 391, 3, 15, ["door", "building", "iopenable"]),
        (f"{d}.OpenSpeed", "field", "public const float OpenSpeed= 0.9f", 80, 116, 5, 5, ["openspeed"]),
        (f"{d}.IsOpen", "property", "public bool IsOpen", 125, 157, 6, 6, []),
        (f"{d}.public Door(int hp)", "constructor", "public Door(int hp)", 166, 199, 7, 7, ["init", "hp"]),
        (f"{d}.public void Tick(int delta)", "method", "public void Tick(int delta)", 208, 347, 8, 13, ["helper", "log", "var", "c", "comp_power", "init", "delta"]),
        (f"{d}.private void Init(int hp)", "method", "private void Init(int hp)", 356, 385, 14, 14, []),
    ]
    refs = {c["id"]: r for c, r, _ in csharp.parse(CODE)}
    assert refs[d] == [("Building", "Inherits"), ("IOpenable", "Inherits"), ("Init", "Calls"), ("Helper.Log", "Calls"), ("Comp_Power", "References"), ("Init", "Calls")]
    assert refs[f"{d}.public Door(int hp)"] == [("Init", "Calls")]


def test_harder_code():
    code = textwrap.dedent("""
        using System;
        namespace A.B;
        [Obsolete("Call()")]
        public static class Outer<T> where T : class {
            /* class No { } */ // void Neither() {}
            public delegate void D(int x);
            public enum E { One, Two }
            private int plain = Make(1);
            public event Action Changed;
            public Dictionary<string, List<int>> Map => Build<int>(s => s.Length);
            public const string Text = "{ \\" }", More = @"x""y";
            public async Task<int> Run<U>(ref int a, string b = "},", params object[] rest) { return await this.Other(a).Then(); }
            public int this[int i] => 1;
            public static Outer<T> operator +(Outer<T> a, Outer<T> b) => a;
            internal struct Inner { public int X { get { return Get(); } } }
            void Short() => Call($"{x}");
        }
        interface IShape { void Draw(); int Size { get; } }
        record Point(int X, int Y);
    """)
    got = {(c["symbol_kind"], c["id"]) for c, _, _ in csharp.parse(code)}
    o = "A.B.Outer"
    assert got == {
        ("type", o), ("property", f"{o}.Map"), ("field", f"{o}.Text"), ("method", f"{o}.public async Task<int> Run(int a, string b, object[] rest)"), ("type", f"{o}.Inner"), ("property", f"{o}.Inner.X"), ("method", f"{o}.void Short()"),
        ("type", "A.B.IShape"), ("method", "A.B.IShape.void Draw()"), ("property", "A.B.IShape.int Size".replace("int ", "")), ("type", "A.B.Point"),
    }
    refs = dict((c["id"], r) for c, r, _ in csharp.parse(code))
    assert ("Call", "Calls") in refs[f"{o}.void Short()"] and ("Build", "Calls") in refs[f"{o}.Map"] and ("this.Other", "Calls") in refs[f"{o}.public async Task<int> Run(int a, string b, object[] rest)"]


def test_unfinished_code_does_not_hang():
    for cut in range(0, len(CODE), 7):
        list(csharp.parse(CODE[:cut]))
    list(csharp.parse("class { ( [ } ) < > ;;; class X : {"))


def test_definitions():
    (door, refs, _), (steel, none, _) = xml_defs.parse(DEFS)
    assert (door["id"], door["start_line"], door["end_line"]) == ("xml:ThingDef:Door <- BaseDoor", 2, 10) and (steel["id"], steel["start_line"]) == ("xml:ThingDef:Steel", 11)
    assert door["preview"].split("\n\n")[0] == "ThingDef: Door (inherits BaseDoor)\nLabel: door\nDescription: A simple door.\nClass: Building_Door\nStats: MaxHitPoints=160, Beauty=0\nComps: Power\nCost: Steel×25"
    assert refs == [("Game.Building_Door", "XmlBindsClass"), ("Game.CompProperties_Power", "XmlUsesComp"), ("BaseDoor", "XmlInherits"), ("Steel", "XmlReferences")] and none == []
    assert "16001" not in door["keywords"] and "16001" in next(xml_defs.parse(DEFS, strict_compat=True))[0]["keywords"]


def test_titles_of_other_types():
    text = """<D>
      <RecipeDef><defName>R</defName><products><Meal>2</Meal></products><ingredients><li><filter><categories><li>Meat</li></categories></filter><count>3</count></li><li><filter><thingDefs><li>Rice</li></thingDefs></filter></li></ingredients><recipeUsers><li>Stove</li></recipeUsers><workAmount>300</workAmount></RecipeDef>
      <HediffDef><defName>H</defName><tendable>true</tendable><lethalSeverity>1</lethalSeverity><stages><li><painFactor>2</painFactor></li><li><capMods><li><capacity>Moving</capacity><offset>-0.1</offset></li></capMods></li></stages></HediffDef>
      <PawnKindDef><defName>P</defName><race>Human</race><weaponTags><li>Gun</li><li>Gun</li><li>Axe</li></weaponTags></PawnKindDef>
      <GeneDef><defName>G</defName><biostatMet>1</biostatMet><statOffsets><Speed>2</Speed></statOffsets><prerequisite>F</prerequisite></GeneDef></D>"""
    r, h, p, g = ((c["preview"].split("\n\n")[0].split("\n")[1:], refs) for c, refs, _ in xml_defs.parse(text))
    assert r[0] == ["Workbenches: Stove", "Products: Meal×2", "Ingredients: Meat×3, Rice×?", "WorkAmount: 300"] and r[1] == [("Meal", "XmlReferences"), ("Rice", "XmlReferences")]
    assert h[0] == ["Tendable: Yes", "Stages: 2", "Stage 1: pain 2", "Stage 2: Moving -0.1", "Lethal at severity: 1"]
    assert p[0] == ["Race: Human", "Weapons: Gun, Axe"] and p[1] == [("Human", "XmlReferences")]
    assert g[0] == ["Metabolic: 1", "Effects: Speed 2", "Prerequisite: F"]


def test_adjacency_format(spark, tmp_path):
    data = files.pack_adjacency(b"CSR1", [0, 2, 3, 3], [1, 2, 2], [1, 2, 1])
    row, index, kind = files.unpack_adjacency(data)
    assert (row.tolist(), index.tolist(), kind.tolist()) == ([0, 0, 1], [1, 2, 2], [1, 2, 1])
    for bad in (data[:-1], data[:4] + struct.pack("<i", 2) + data[8:], b""):
        with pytest.raises(ValueError):
            files.unpack_adjacency(bad)
    (tmp_path / "g.bin").write_bytes(data)
    (tmp_path / "n.tsv").write_text("0\tA\n1\tB\n2\tC\n")
    got = {tuple(r) for r in files.read_adjacency(spark, str(tmp_path / "g.bin"), str(tmp_path / "n.tsv")).collect()}
    assert got == {("A", "B", "Calls", 1), ("A", "C", "References", 1), ("B", "C", "Calls", 1)}


def test_vectors_and_file_state(spark, tmp_path):
    (tmp_path / "v.jsonl").write_text('{"id":"A","path":"1","preview":"p","vector":[1,2]}\nnot json\n{"id":"a","path":"2","preview":"q","vector":[3]}\n{"id":"","vector":[1]}\n{"id":"b","preview":""}\n')
    assert [(r.id, r.vector) for r in files.read_vectors(spark, str(tmp_path / "v.jsonl")).collect()] == [("A", [1.0, 2.0])]
    (tmp_path / "m.json").write_text('{"x.cs": 1500, "y.xml": 2500}')
    state = files.read_file_state(spark, str(tmp_path / "m.json"))
    assert files.file_state_json(state) == '{"x.cs": 1500, "y.xml": 2500}'
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(tmp_path / "none"))
