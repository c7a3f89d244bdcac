import pytest

from cartograph.functions.lexer import without_comments
from cartograph.functions.members import find_members
from cartograph.operators import extract

SHARP = '''namespace Harbour.Tides;

public partial class TideTable
{
    internal TideTable(int station, [Unit("m")] double datum = 0.5) : base(station)
    {
        Datum = datum; // metres
    }

    #region heights
    /// <remarks>Highest first.</remarks>
    public double[] Heights(System.DateTime day, bool night)
    {
        /* one a quarter */ var text = @"a ""quay"" // with } braces";
        return night ? Below($"{day:d}/{text.Length}") : null; // may be null
    }
    #endregion

    public (int hour, int minute) Slack { get; internal set; } = (6, 30);
    protected abstract double Below(string mark);
    public static TResult Pick<TKey, TResult>(TKey key) where TKey : notnull => default!;
    struct Gauge { public void Reset() { } }
}
'''
SCRIPT = '''import { Sky } from './sky';
export class Kite<T extends Sky> {
  protected line: Map<string, T[]> = new Map();
  constructor(readonly span: number, private tail?: T) { this.line.clear(); }
  public async lift(wind: { knots: number }): Promise<{ metres: number }> {
    // a comment with a brace }
    return { metres: /[}]{2}/.test(`w${wind.knots + `{`}`) ? 1 : 2 };
  }
  get aloft(): boolean { return true; }
  private reel(turns: number): void { }
}
export interface Breeze { gust(seconds: number): void; bearing?: number }
export function knots(metres: number): string { return (metres * 1.94).toFixed(1); }
function untangle() { }
export type Rig = {
  bridle: string;
};
export const enum Shape { Delta = 'delta', Box = 'box' }
'''


def test_csharp_members():
    found = [(m.kind, m.container, m.name, m.signature, m.is_public) for m in find_members(SHARP, "csharp")]
    assert found == [
        ("constructor", "TideTable", "TideTable", 'internal TideTable(int station, [Unit("m")] double datum = 0.5)', False),
        ("method", "TideTable", "Heights", "public double[] Heights(System.DateTime day, bool night)", True),
        ("property", "TideTable", "Slack", "public (int hour, int minute) Slack { get; internal set; }", False),
        ("method", "TideTable", "Below", "protected abstract double Below(string mark)", False),
        ("method", "TideTable", "Pick", "public static TResult Pick<TKey, TResult>(TKey key)", True),
        ("method", "TideTable.Gauge", "Reset", "public void Reset()", True),
    ]


def test_script_members():
    found = {m.name: (m.kind, m.container, m.signature, m.is_public) for m in find_members(SCRIPT, "typescript")}
    assert found["lift"] == ("method", "Kite", "public async lift(wind: { knots: number }): Promise<{ metres: number }>", True)
    assert found["line"][2] == "protected line: Map<string, T[]>" and found["constructor"][3] is False
    assert found["aloft"][2] == "get aloft(): boolean" and found["reel"][3] is False
    assert found["gust"] == ("method", "Breeze", "gust(seconds: number): void", True)
    assert found["bearing"][2] == "bearing?: number"
    assert found["knots"] == ("function", "<global>", "function knots(metres: number): string", True) and found["untangle"][3] is False
    assert found["Rig"][2] == "type Rig" and found["Shape"][2] == "enum Shape"


SOURCES = [
    # language, source, (container, name) of each member
    ("csharp", "#if NET8\nclass A { void New() { } }\n#else\nclass A { void Old() { } }\n#endif", [("A", "Old")]),
    ("csharp", "#define FAST\n#if FAST && !SLOW\nclass A { void F() { } }\n#elif SLOW\nclass A { void S() { } }\n#endif", [("A", "F")]),
    ("csharp", "class A {\n#if DEBUG\n void D() { }\n #if X\n void X() { }\n #endif\n#endif\n void R() { }\n}", [("A", "R")]),
    ("csharp", "using System;\nint Twice(int n) => n * 2;\nConsole.WriteLine(Twice(2));\nclass A { void M() { } }", [("A", "M")]),
    ("csharp", "record Point(int X, int Y) { public int Sum() => X + Y; }", [("Point", "Sum")]),
    ("csharp", "interface IShip { void Sail(); int Draft { get; } }", [("IShip", "Sail"), ("IShip", "Draft")]),
    ("csharp", "class A { Dictionary<string, List<(int, int)>> Map(Func<int, bool> f) { return null; } }", [("A", "Map")]),
    ("csharp", "class A { string R() { return QQQ\n } class B { void X() { } }\nQQQ; } void S() { } }".replace("QQQ", 3 * '"'), [("A", "R"), ("A", "S")]),
    ("csharp", "class A { char C() { return '}'; } void D() { } }", [("A", "C"), ("A", "D")]),
    ("csharp", 'class A { string I(int n) => $"{(n > 0 ? "}" : "{")}"; void J() { } }', [("A", "I"), ("A", "J")]),
    ("csharp", "enum E { A, B }\ndelegate void D(int x);\nclass A { event Action Moved; int f = 3; int this[int k] => k; void M() { } }", [("A", "M")]),
    ("csharp", "class A { public static A operator +(A a, A b) => a; ~A() { } void M() { } }", [("A", "M")]),
    ("csharp", "namespace N { namespace M { class A { class B { void C() { } } } } }", [("A.B", "C")]),
    ("csharp", "class A<T> where T : new() { [Obsolete(\"}\")] public T Make() { return new T(); } }", [("A", "Make")]),
    ("csharp", "class A { void IDisposable.Dispose() { } async Task<int> Run() => await Go(); }", [("A", "Dispose"), ("A", "Run")]),
    ("csharp", "class A { int P { get => p; set { p = value; } } int Q => 3; }", [("A", "P"), ("A", "Q")]),
    ("csharp", "class A { unsafe int* P(int* p) { return p; } ref int R(ref int x) => ref x; }", [("A", "P"), ("A", "R")]),
    ("csharp", "class @event { void @class() { } }", [("event", "class")]),
    ("typescript", "function g() { return <p>it's</p>; }\nfunction h() {}", [("<global>", "g"), ("<global>", "h")]),
    ("typescript", "const v = <div className=\"a}\">{list.map(x => <b key={x}>don't {x} \"</b>)} o'clock</div>;\nfunction h() { }", [("<global>", "h")]),
    ("typescript", "function f() { return (<>a 'b <i/> {`}`} </>); }\nclass C { m() { return <A b={{ c: 1 }} />; } n() { } }", [("<global>", "f"), ("C", "m"), ("C", "n")]),
    ("typescript", "function f(a: number, b: number) { return a < b && b > a; }\nfunction g() { }", [("<global>", "f"), ("<global>", "g")]),
    ("typescript", "const id = <T,>(x: T) => x;\nfunction f<T>(x: Array<T>): x is T[] { return a<b>(c); }\nfunction g() { }", [("<global>", "f"), ("<global>", "g")]),
    ("typescript", "class A { bar<T>(x: T): T { return x; } static #n = 1; #p() { } }", [("A", "bar"), ("A", "#n"), ("A", "#p")]),
    ("typescript", "interface I<T> extends J<T> { a: T; b(): void; [k: string]: unknown; (x: number): string }", [("I", "a"), ("I", "b")]),
    ("typescript", "type U = 'a' | 'b';\nenum E { A }\ndeclare module 'm' { function f(): void; export function g() { } }", [("<global>", "U"), ("<global>", "E"), ("<global>", "g")]),
    ("typescript", "export default class { run() { } }\nexport default function main() { }", [("<global>", "run"), ("<global>", "main")]),
    ("typescript", "abstract class A { abstract a(): void; f(x: string): void; f(x: any) { } }", [("A", "f")]),
    ("typescript", "@Dec({ a: '}' }) class A { @Input() x = 1; @On('e') go() { } }", [("A", "x"), ("A", "go")]),
    ("typescript", "function* gen() { yield /}/; }\nasync function run() { }", [("<global>", "gen"), ("<global>", "run")]),
    ("typescript", "class A { handler = () => { return 1; };\n  get [Symbol.iterator]() { return 2; } }", [("A", "handler"), ("A", "[Symbol.iterator]")]),
    ("typescript", "namespace N { export class A { m() { } } }", [("A", "m")]),
]


@pytest.mark.parametrize("language, source, wanted", SOURCES)
def test_members_of_sources(language, source, wanted):
    assert [(m.container, m.name) for m in find_members(source, language)] == wanted


def test_type_parameters_are_not_part_of_signatures():
    found = {m.name: m.signature for m in find_members("class A { bar<T>(x: T): T { return x; } }\nfunction id<T extends object>(x: T): T { return x; }", "typescript")}
    assert found == {"bar": "bar(x: T): T", "id": "function id(x: T): T"}


def test_spans_are_slices_and_comments_go():
    for source, language in ((SHARP, "csharp"), (SCRIPT, "typescript")):
        for m in find_members(source, language):
            assert source[m.start : m.end].strip() == source[m.start : m.end]
            if m.body_start is not None:
                assert m.start < m.body_start < m.body_end <= m.end
    assert without_comments('a // x\n"//y" /* z */ b', "typescript") == 'a \n"//y"  b'
    assert without_comments('var s = @"a""//b"; // c', "csharp") == 'var s = @"a""//b"; '


@pytest.mark.parametrize("text", ["", "{{{{", "}}}}", "class", "class A", "class A {", "public class A { void M(", '"open', "/* open", "`${", "interface X { a(", "@", "type X =", "<<<>>>", "class A { [", "enum", "namespace"])
@pytest.mark.parametrize("language", ["csharp", "typescript"])
def test_broken_source_gives_rows_or_none(text, language):
    assert isinstance(find_members(text, language), list)


@pytest.fixture(scope="module")
def members(spark):
    rows = [("sea/Tides.cs", SHARP), ("sky/kite.ts", SCRIPT), ("gone.cs", None)]
    return extract.extract_members(spark.createDataFrame(rows, "path string, content string")).cache()


def test_rows(members):
    assert [r["path"] for r in extract.errors(members).collect()] == ["gone.cs"]
    lines = [r["value"] for r in extract.signature_lines(extract.signatures(members)).collect()]
    assert all(line.count("\t") == 3 for line in lines) and any(line.startswith("sea/Tides.cs:5\tTideTable") for line in lines)
    names = {r["path"]: r["names"] for r in extract.public_names(members).collect()}
    assert names == {"sea/Tides.cs": ["Heights", "Pick", "Reset"], "sky/kite.ts": ["lift", "aloft", "gust", "knots"]}


def test_member_source(members):
    one = lambda *a: extract.member_source(members, *a).collect()
    full = one("Heights")[0]
    assert SHARP[full["start_char"] : full["end_char"]] == full["content"] and full["start_line"] == 12 and full["end_line"] == 16
    head = one("Heights", None, extract.SIGNATURE_ONLY)[0]
    assert head["content"] == "public double[] Heights(System.DateTime day, bool night)" and head["end_line"] == 12
    assert SHARP[head["start_char"] : head["end_char"]] == head["content"]
    body = one("Heights", None, extract.BODY_ONLY)[0]
    assert body["content"].startswith("{") and body["content"].endswith("}") and (body["start_line"], body["end_line"]) == (13, 16)
    bare = one("Heights", None, extract.BODY_WITHOUT_COMMENTS)[0]
    assert "quarter" not in bare["content"] and "may be null" not in bare["content"] and '// with } braces"' in bare["content"]
    assert (bare["start_char"], bare["end_char"]) == (body["start_char"], body["end_char"])
    assert not one("Below", None, extract.BODY_ONLY) and len(one("Below", None, extract.SIGNATURE_ONLY)) == 1
    assert len(one("Reset", "Gauge")) == 1 and not one("Reset", "TideTable") and len(one("TideTable")) == 1
    assert not one("gust", None, extract.BODY_ONLY)
    script = one("lift", None, extract.BODY_WITHOUT_COMMENTS)[0]
    assert "a comment" not in script["content"] and script["content"].endswith("? 1 : 2 };\n  }")
    with pytest.raises(ValueError):
        one("Reset", None, "half")


def test_filters_and_sinks(members):
    rows = extract.signatures(members)
    assert {r["member_name"] for r in extract.filter_signatures(rows, r"HEIGHTS\|knots$").collect()} <= {"Heights", "knots", "lift"}
    with pytest.raises(ValueError):
        extract.filter_signatures(rows, "(")
    blocks = [r["block"] for r in extract.signature_blocks(rows).collect()]
    assert blocks[0].startswith("sea/Tides.cs\n  5\tTideTable\tTideTable\t") and len(blocks) == 2
    assert [r[0] for r in extract.suggest_names(members, "HEIGHT").collect()] == ["Heights"]
    assert extract.to_json_array(extract.member_source(members, "nope")) == "[]"
    assert '"member_name": "Below"' in extract.to_json_array(extract.member_source(members, "Below"))


def test_table_function(spark):
    extract.register_table_function(spark)
    spark.createDataFrame([("a.ts", "function f() {}")], "path string, content string").createOrReplaceTempView("sources")
    rows = spark.sql("SELECT m.member_name FROM sources, LATERAL extract_members(sources.path, sources.content) m").collect()
    assert [r[0] for r in rows] == ["f"]


def test_offsets(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(extract.utf16_offset(F.lit("a🙂b"), F.lit(2)).alias("u"), extract.line_of(F.lit("a\nb"), F.lit(2)).alias("l")).first()
    assert row["u"] == 3 and row["l"] == 2
