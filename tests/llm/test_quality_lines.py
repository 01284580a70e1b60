import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests.llm.conftest import words
from worktrace.llm import lines, quality


def brute_repeats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    spans = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(spans)
    return len({k for i, s in enumerate(spans) if n[s] > 1 for k in range(i, i + 5)})


def test_base_counts_equal_brute_force(edge_docs, edge_rows):
    rows = {r.doc_id: r for r in quality.score(edge_docs).collect()}
    for i, text, *_ in edge_rows:
        if i is None:
            continue
        t, r = text or "", rows[i]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        shown = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(shown) - len(set(shown)), brute_repeats(t))
        assert r.base_failed == (len(w) < 10 or 100 * brute_repeats(t) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_repeated_windows():
    assert quality.repeated_words("a b c d e f a b c d e".split()) == 10
    assert quality.repeated_words(["a"] * 6) == 6 and quality.repeated_words("a b c d".split()) == 0


def english(seed, n):
    import random

    return " ".join(random.Random(seed).choices(quality.COMMON_WORDS["en"][:12] + words(1, 40).split(), weights=[6] * 12 + [2] * 40, k=n))


def test_far_documents_go_and_clean_ones_stay(spark):
    clean = [(i, english(i, 150 + 10 * i), "en") for i in range(60)]
    odd = [
        (100, "### *** " * 3 + " ".join(f"{w}%%%$$$" for w in english(7, 150).split()), "en"), (101, words(77, 400), "en"),
        (102, "## $$ %% && " + words(9, 12), "en"),
    ]
    rows = {r.doc_id: r for r in quality.score(spark.createDataFrame(clean + odd, "doc_id long, text string, lang string")).collect()}
    assert all(rows[i].kept for i in range(60))
    assert not rows[100].kept and rows[100].class_distance > quality.MAX_CLASS_DISTANCE
    assert not rows[101].kept and rows[101].common_distance > quality.MAX_COMMON_DISTANCE
    assert rows[102].kept and rows[102].common_distance is None  # too short to compare


def test_junk_of_a_third_of_the_rows_goes(spark):
    from itertools import product

    clean = [(i, english(i, 150 + 10 * i), "en", "prose") for i in range(60)]
    junk = [(200 + i, " | ".join(english(500 + i, 110 + 10 * i).split()), "en", "lists") for i in range(30)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    for f, x in product((lambda d: quality.keep_good(d), lambda d: quality.score(d).filter("kept")), (docs, docs.repartition(3))):
        assert sorted(r.doc_id for r in f(x).collect()) == list(range(60))


def test_a_language_without_documents_near_its_medians_keeps_the_plain_reference(spark):
    halves = [(i, " ".join("a" * 40 + str(k) if i % 2 else "$" * 40 + "#" * k for k in range(31)), "xx") for i in range(40)]
    docs = spark.createDataFrame(halves, "doc_id long, text string, lang string")
    rows = quality.measured(docs, "text", "lang")
    refs = quality.robust_references(rows).collect()
    assert [(r.lang, r.ref_words) for r in refs] == [("xx", 40 * 31)]


def greek(seed, n):
    import random

    letters = "αβγδεηικλμνοπρστυω"
    made = lambda k: "".join(random.Random(k).choices(letters, k=3 + k % 6))
    return " ".join(random.Random(seed).choices([made(k) for k in range(50)], weights=[9] * 12 + [1] * 38, k=n))


def test_a_language_without_fixed_words_is_judged_by_its_own(spark):
    clean = [(i, greek(i, 200 + 10 * i), "el") for i in range(60)] + [(1000 + i, english(i, 200), "en") for i in range(30)]
    other = [
        (100, " ".join(w[::-1] + "ξ" for w in greek(900, 300).split()), "el"),
        (101, "".join(chr(0x430 + (ord(c) - 0x3B1)) if c != " " else c for c in greek(901, 300)), "el")
    ]
    docs = spark.createDataFrame(clean + other, "doc_id long, text string, lang string")
    own = quality.vocabulary(docs, F.col("text"), F.col("lang")).collect()
    counts = Counter(w for _, t, lang in clean + other if lang == "el" for w in t.split())
    assert [r.lang for r in own] == ["el"]
    assert own[0].own == [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))][: len(quality.VOCABULARY)]
    rows = {r.doc_id: r for r in quality.score(docs).collect()}
    assert all(rows[i].kept for i, *_ in clean)
    assert not rows[100].kept and rows[100].common_distance > rows[0].common_distance
    assert not rows[101].kept and rows[101].class_distance > 0.5


def test_references_of_given_documents(spark):
    clean = spark.createDataFrame([(i, english(i, 300), "en") for i in range(30)], "doc_id long, text string, lang string")
    loud = spark.createDataFrame([(i, english(i, 300).upper(), "en") for i in range(30)], "doc_id long, text string, lang string")
    assert quality.keep_good(loud).count() == 30  # nothing else to compare with
    assert quality.keep_good(loud, references_of=clean).count() == 0
    assert quality.score(clean, references_of=clean).filter("kept").count() == 30


def test_character_classes():
    names = [*quality.CLASSES, *quality.SCRIPTS, "other"]
    text = "aZ1 .#~éλжא漢カ한ก—अ😀\u0300"
    got = {n: c for n, c in zip(names, quality.character_classes(text).tolist(), strict=True) if c}
    assert got == {
        "lower": 1, "upper": 1, "digit": 1, "space": 1, "mark": 1, "symbol": 1, "latin": 1, "greek": 1, "cyrillic": 1,
        "semitic": 1, "han": 1, "kana": 1, "hangul": 1, "southeast": 1, "punctuation": 1, "indic": 1, "other": 3,
    }
    assert quality.character_classes("").sum() == 0


def test_distance(spark):
    row = spark.sql("select array(1L, 1L) as a, array(2L, 2L) as b, array(0L, 5L) as c, array(7L, 0L) as d, array(0L, 0L) as e")
    one = lambda x, n, y, m: row.select(quality.distance(F.col(x), F.lit(n), F.col(y), F.lit(m))).first()[0]
    assert one("a", 2, "b", 4) == 0 and one("c", 5, "d", 7) == 1 and one("e", 0, "a", 2) is None


def test_quality_tables_without_rows_or_values(no_docs, null_docs, edge_docs):
    assert quality.score(no_docs).count() == 0 and quality.keep_good(no_docs).count() == 0
    assert [r.kept for r in quality.score(null_docs).collect()] == [False] * 5
    kept = quality.keep_good(edge_docs)
    assert kept.columns == edge_docs.columns
    good = Counter(r.doc_id for r in quality.score(edge_docs).collect() if r.kept)
    assert Counter(r.doc_id for r in kept.collect()) == good


def test_lines_equal_brute_force(spark):
    pages = [(i, f"http://h{i % 2}.example/{i}", f"menu\n  body {i}\n\nmenu\nfoot {i % 4}\n{'x' * (i % 3)}") for i in range(40)]
    pages += [
        (100, None, "menu\nx"), (101, "no url", "menu"), (102, "http://small/1", "a"), (103, "http://small/2", "a"),
        (104, "HTTP://u:p@H0.example:80", None), (105, "http://h1.example", ""), pages[0],
    ]
    pages += [(106, "http://h0.example/long", "\n".join(f"line {k}" for k in range(60_000)) + "\nmenu\n" + "z" * 2_000_000)]
    df = spark.createDataFrame(
        [(*p, "h", [1], "c") for p in pages],
        "page_id long, url string, body string, host string, lines array<int>, common string",
    )
    hosts, seen = Counter(), defaultdict(Counter)
    cut = []
    for i, url, text in pages:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        own = [x.strip(" \t\r\v\f") for x in (text or "").split("\n")]
        cut.append((i, m and m[1].lower(), [x for x in own if x]))
        hosts[cut[-1][1]] += 1
        seen[cut[-1][1]].update(set(cut[-1][2]))
    want = []
    for i, h, own in cut:
        kept = [x for x in own if h is None or hosts[h] < lines.MIN_PAGES or seen[h][x] <= lines.RATIO * hosts[h]]
        want.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    got = lines.clean(df, F.col("body"))
    assert sorted((r.row.page_id, r.n_lines, r.n_dropped, r.cleaned) for r in got.collect()) == sorted(want)
    assert lines.clean(df.limit(0), F.col("body")).count() == 0
    nulls = spark.createDataFrame([(None,) * 6] * 3, df.schema)
    assert [r.n_lines for r in lines.clean(nulls, F.col("body")).collect()] == [0, 0, 0]


def test_html_text(spark):
    html = "<html><head><style>p{}</style><TITLE>T</TITLE></head><!-- no --><p>a<b>b</b><br>c<script>x('</p>')</script></p>"
    text = spark.createDataFrame([(html,)], "h string").select(lines.lines_of(lines.html_text(F.col("h")))).first()[0]
    assert text == ["T", "ab", "c"]
