from collections import Counter

import pytest

from leafmill.llm.markup import Block, clean, cleaned, kinds, label_blocks
from leafmill.llm.scan import Reader, defects, masked, repaired, skeleton, titled
from leafmill.llm.vocabulary import terms


@pytest.mark.parametrize(
    "text,want",
    [
        ("<p>One</p>", ["html"]), ("a<br>b", ["html"]), ("x &amp; y", ["html"]), ("&notanentity; x", []), ("if a < b and c > d", []), ("数值应当 < 324，并且不得 > 4", []),
        ("<!-- note -->", ["html"]), ("List<Integer> a = new ArrayList<>(3);", []), ("**bold** text", ["markdown"]), ("__bold__ text", ["markdown"]), ("~~gone~~", ["markdown"]),
        ("use `code` here", ["markdown"]), ("[t](http://x.y/z)", ["markdown"]), ("![a b](img/1.png)", ["markdown"]), ("```\nx\n```", ["markdown"]), ("a | b\n---|---\n1 | 2", ["markdown"]),
        ("# Title\n- item\n1. one\n* star", []), ("def f(a, *args, **kw):", []), ("35 * 643 square", []), ("snake_case and other_name_", []),
        ("[[Page|text]] more", ["wiki"]), ("{{cite web|x}}", ["wiki"]), ("== Head ==", ["wiki"]), ("''it'' and '''bold'''", ["wiki"]), ('{| class="x"\n|-\n| a || b\n|}', ["wiki"]), ("see [https://x.y/z label] now", ["wiki"]),
        ("a == b", []), ("it''s", []), (r"\section{A} text", ["latex"]), (r"the \emph{word}", ["latex"]), (r"$\alpha_{5} \leq d^{2}$", ["latex"]), ("$402 while $5", []), (r"C:\archive\ablage\692", []), (r"{\it even though} x", ["latex"]),
        ("[第3页]\n[表头] a | b\n[工作表: X]", []), ("[代码文件: a.js]\n<p>`x`", []), ("", []), ("<b>x</b> **y** [[z]] \\emph{w}", ["html", "markdown", "wiki", "latex"]),
    ],
)
def test_kinds(text, want):
    assert kinds(text) == want


def test_clean_html():
    page = "<h1>Head</h1><p>The text of the <b>page</b> is here &amp; it goes on for a while, as it does with text.</p><ul><li>one</li><li>two</li></ul><pre><code>x = 1\n  y</code></pre><table><tr><td>a</td><td>b</td></tr></table><script>bad()</script>"
    text, dropped = clean(page, ["html"])
    assert text == "# Head\nThe text of the page is here & it goes on for a while, as it does with text.\n- one\n- two\n```\nx = 1\n  y\n```\na | b" and dropped == 0


def test_clean_drops_menus():
    body = "The text of this page is about the things that it is about, and it goes on for as long as it has to. " * 2
    page = f'<a href="/a">Home and start</a><a href="/b">About us</a><p>{body}</p><p><a href="/c">Imprint</a></p>'
    text, dropped = clean(page, ["html"])
    assert text == body.strip() and dropped == 2


def test_clean_other_markup():
    assert clean("## Head\nThe **bold** [link](http://x) and `code`\n```py\n**kept**\n```\n- [x] done", ["markdown"])[0] == "## Head\nThe bold link and code\n```\n**kept**\n```\n- [x] done"
    assert clean("== Head ==\nThe '''bold''' [[Page|text]]{{x|y}}<ref>no</ref> [http://a b c]\n{| class=x\n! a !! b\n|-\n| 1 || 2\n|}", ["wiki"])[0] == "# Head\nThe bold text b c\na | b\n1 | 2"
    tex = r"\section{Head} The \emph{word}\footnote{a note}~\cite{k} has $x_1 = 2$." + "\n" + r"\begin{itemize}\item one \item two\end{itemize}" + r"\begin{equation}a^2\end{equation}"
    assert clean(tex, ["latex"])[0] == "## Head\nThe word (a note) has $x_1 = 2$.\n- one\n- two\n$$a^2$$"


def test_short_blocks_follow_their_neighbours():
    good, bad = "The text is one that has a good many of the words that are common in it. " * 3, "Menu Link One"
    blocks = [Block(good), Block("Short one"), Block(bad, linked=13), Block("Between"), Block("Imprint", linked=7), Block("x=1", "code")]
    label_blocks(blocks)
    assert [b.label for b in blocks] == ["good", "good", "bad", "bad", "bad", "good"]
    alone = [Block("Only this")]
    label_blocks(alone)
    assert alone[0].label == "good"


def test_cleaned(spark):
    junk = "\n".join("qwrtzp <b>hjk</b> asdfg zxcvb qqrt" for _ in range(10))
    prose = "The text of the page is <b>here</b>, and it goes on for a while as it does. It has two sentences."
    rows = [(1, 1, 0, prose, "x"), (1, 1, 0, prose, "x"), (2, 2, 0, junk, "x"), (3, 3, 0, None, "x"), (4, 4, 0, "", "x"), (5, None, 0, prose, "x")]
    df = spark.createDataFrame(rows, "id long, document_id long, chunk_index int, content string, markup string")
    assert sorted((r.id, tuple(r.markup)) for r in cleaned(df).collect()) == [(1, ("html",)), (5, ("html",))]
    assert cleaned(df.limit(0)).count() == 0


TEXT = """The maintenance report confirms the delivery of the remaining modern folders to the northern office, and the warranty sheet explains
the service manual for the pump assembly. According to the annual budget nobody had noticed the emergency procedure until then."""
COUNTS = dict(Counter(w for _ in range(60) for w in terms(TEXT + " Der Kühlkreislauf todavía согласованные описывает long term modern modem")))


def test_skeletons():
    for a, b in (("modern", "modem"), ("service", "scrvice"), ("budget", "bud9et"), ("todavía", "toclavía"), ("assembly", "asscmb1y"), ("procedure", "proceclure"), ("until", "unt1l"), ("согласованные", "согласованнbIе".lower()), ("описывает", "опnсывает"), ("report", "re(ort".replace("(", "p"))):
        assert skeleton(a) == skeleton(b), (a, b)
    assert skeleton("report") != skeleton("budget")


def test_reader_finds_and_repairs():
    r = Reader(COUNTS)
    page = "MAINTENANCE REPORT NORD\nThe servicc manual explains the emer-\ngency procedure to no6ody. The war-\n- 43 -\nMAINTENANCE REPORT NORD\nranty sheet is long-\nterm."
    hyphen, glyph, number, titles, lines = r.read(page, repair=True)
    assert (hyphen, glyph, number) == (True, True, True) and {t[1] for t in titles} == {0, 4}
    assert lines[1][1] == "The service manual explains the emer-" and "nobody" in lines[2][1] and lines[3][2] == "page"
    assert Reader(COUNTS).read("The service manual explains the long-\nterm budget.")[:3] == (False, False, False)
    assert Reader(COUNTS).read("[第3页]\nThe modem and the modern folders, code G11E and 5 * 3.")[:3] == (False, False, False)


def test_context_decides_between_forms():
    contexts = {"the modem": 1, "the modern": 50, "modern folders": 40}
    r = Reader(COUNTS | {"modem": 5000, "modern": 5000}, contexts)
    assert r.rivals() == {"modem", "modern"} and r.correct("m0dern", "the", "folders") == "modern"
    assert Reader(COUNTS, {}).correct("budget", "", "") is None and Reader(COUNTS).correct("xyzzy", "", "") is None


def test_titles_and_page_numbers():
    assert titled("Service Manual Velbosk 2024") and titled("SAFETY NOTES VELKORIX") and titled("塔萨帕公司档案年度回顾")
    assert not titled("the older folders can hardly") and not titled("# Head Line") and not titled("It ends here.") and not titled("x")
    assert masked("Page 12 Manual") == masked("Page 7 Manual") and masked("ARCHlVE") == masked("ARCHIVE")
    r = Reader(COUNTS)
    for line in ("Page 10", "- 39 -", "· 5 ·", "[9]", "9 / 28", "p. 23", "Seite 4", "Página 13", "Page 17 sur 28", "第 9 页 共 12 页", "iv", "17"):
        assert r.read(f"The service manual explains.\n{line}")[2], line
    for line in ("[第9页]", "1990", "a | 9", "9.", "The 9"):
        assert not r.read(f"The service manual explains.\n{line}")[2], line
    assert r.read("Safety Notes Nord    23\nThe service manual explains the budget.")[2:4] == (True, [(masked("Safety Notes Nord"), 0, True, True)])


def test_defects_and_repair(spark):
    filler = [(900 + i, 90 + i, 0, TEXT, "x") for i in range(60)]
    pages = [(i, 5, i, f"Safety Notes Nord\nThe service manual explains the\nannual budget of the northern off-\nice until then, and the report\nconfirms the delivery.\nPage {i}", "x") for i in range(1, 4)]
    rows = filler + pages + [pages[0], (50, 5, 1, pages[0][3], "x"), (60, 6, 0, "The servicc manual explains the bud9et.", "x"), (70, 7, 0, None, "x"), (71, 7, 1, "", "x"), (72, None, None, "The service manual.", "x")]
    df = spark.createDataFrame(rows, "id long, document_id long, chunk_index int, content string, defect string")
    got = {}
    for r in defects(df).collect():
        got.setdefault(r.id, []).append(r.defect)
    assert {i: sorted(d) for i, d in got.items()} == {**{i: ["header", "hyphen", "page_number"] for i in (1, 2, 3, 50)}, 60: ["glyph"]}
    fixed = {r.id: r.content for r in repaired(df).collect()}
    assert fixed[1] == "The service manual explains the annual budget of the northern office until then, and the report confirms the delivery."
    assert fixed[60] == "The service manual explains the budget." and fixed[70] == "" and fixed[71] == "" and len(fixed) == 68
    assert defects(df.limit(0)).count() == 0 and repaired(df.limit(0)).count() == 0


def test_titles_with_numbers_beside_tables_and_over_many_pages():
    r = Reader(COUNTS)
    body = "The service manual explains\nthe annual budget.\n"
    pages = "".join(f"Safety Notes Nord    {n}\n{body}" for n in range(21, 27))
    assert [t[1] for t in r.read(pages)[3] if t[2]] == [0, 3, 6, 9, 12, 15] and r.read(pages)[2]
    tabs = "".join(f"Safety Notes Nord\t{n}\n{body}a    b\n" for n in range(21, 27))
    assert r.read(tabs)[2]
    table = "".join(f"Pump {x}    {n}\n" for n, x in enumerate(("North", "South", "East", "West", "Total"), 2))
    assert not r.read(body + table)[2]
    assert [t[1] for t in r.read("Safety Notes Nord    23\n" + body + table)[3] if t[2]] == [0]


@pytest.mark.parametrize(
    "text,want,left",
    [
        ("{{Infobox place\n| name = Nord\n| area = 12\n}}\nNord is here.", ["wiki"], "Nord is here."), ("{{cite " + "word " * 100 + "}} After.", ["wiki"], "After."), ("'''''both''''' words", ["wiki"], "both words"),
        ("$$" + "a + b + " * 100 + "c$$", ["latex"], "$$" + "a + b + " * 100 + "c$$"), ("$x = " + "a + " * 100 + "b$", ["latex"], "$x = " + "a + " * 100 + "b$"),
        ("***bold italic*** text", ["markdown"], "bold italic text"), ("___bold italic___ text", ["markdown"], "bold italic text"), ("**" + "word " * 100 + "end** text", ["markdown"], "word " * 100 + "end text"),
        ("a ** b ** c *** d", [], None), ("{{ open only\nand more", [], None), ("*** * ***", [], None), ("costs $5 or 6$ more", [], None),
    ],
)
def test_long_markup(text, want, left):
    assert kinds(text) == want
    if left is not None:
        assert clean(text, want)[0] == left


def test_block_labels_decide_whether_a_sign_counts(spark):
    """Two texts with the same sign: it counts in a line of prose or without decided neighbours, not among unreadable lines or in code."""
    sign = r"\[ a \]"
    soup = "%|;?|[+>#=;]%~&<>*/{?$+{<@~|%$?[@*}%[<\\/@/<[==;.$|*]::+.!-^~[$|>}^/>/]|@:$*{<*|&}"
    cipher = r'k$4:a2$ "3q76# ;7;k:1. ;je&$ a72%0$ 4j$ (3 "%$ \2z $#q87. (k0$5e'
    prose = "The pump is cleaned with a brush and the filter of the engine is then put back where it was before, so that the unit can be used again."
    assert kinds(f"{prose}\n{sign}\n{prose}") == ["latex"] and kinds(sign) == ["latex"]
    assert kinds(f"{soup}\n{sign}\n{soup}") == [] and kinds(f"{cipher}\n{sign}\n{cipher}\n{soup}") == []
    assert kinds(f"{soup}\n{soup}\n{prose}\n{sign}") == ["latex"]
    code = "def area(x):\n    y = x ** 2 + z ** 3\n    return y;"
    assert kinds(code) == [] and kinds(code + "\n\n" + prose + " It is **new**.") == ["markdown"]
    rows = [(1, 1, f"{prose}\n{sign}"), (2, 2, f"{soup}\n{sign}\n{soup}"), (2, 2, f"{soup}\n{sign}\n{soup}"), (3, 3, None), (4, 4, "")]
    assert [r.id for r in cleaned(spark.createDataFrame(rows, "id long, document_id long, content string")).collect()] == [1]
    blocks = [Block(soup), Block("a \\ b"), Block(code.split("\n")[1], "code"), Block("x = 1"), Block(prose + prose)]
    label_blocks(blocks)
    assert [b.label for b in blocks] == ["junk", "junk", "good", "good", "good"]


def test_rare_words_are_meant_too(spark):
    """A word far below 1 / 60,000 of the corpus is found by the join, with the same result as if it were frequent; of rare rivals the neighbours decide."""
    filler = [(1000 + i, 50 + i % 7, i, f"alpha{chr(97 + i % 26)} " * 3 + "the service manual explains the annual budget", "x") for i in range(200)]
    known = [(i, 3, i, "near Velbosk the modem line and the modern folders of Velbosk servicemanual", "x") for i in range(25)]
    read = [(500, 4, 0, "near Ve1bosk the VELB0SK", "x"), (501, 4, 1, "the m0dern folders", "x"), (502, 4, 2, "the m0dem line", "x"), (503, 4, 3, "the service-\nmanual is new", "x"), (504, 4, 4, "the annual-\nbudget is new", "x"), (None, 4, 4, "near Velb0sk", "x")]
    df = spark.createDataFrame(filler + known + read, "id long, document_id long, chunk_index int, content string, defect string")
    frequent_too, rare = ({(r.id, r.defect) for r in defects(df, bound=b).collect()} for b in (60_000, 12))
    assert frequent_too == rare == {(500, "glyph"), (501, "glyph"), (502, "glyph"), (None, "glyph"), (503, "hyphen")}
    for b in (60_000, 12):
        fixed = {r.id: r.content for r in repaired(df, bound=b).collect()}
        assert [fixed[i] for i in (500, 501, 502)] == ["near Velbosk the VELBOSK", "the modern folders", "the modem line"]
