"""Quality rules: base counts of a text, and divergence from its language's reference.

A document's histogram of character classes and its histogram of common words are
compared with those of its language by the Jensen-Shannon distance. The references
are robust: bin by bin the median share over all documents of the language that
pass the base rules is what junk of less than half of them can't move far, and the
documents near the medians are summed. (`robust=False`: sums over all that pass the
base rules, junk included, and looser bounds, as OP2_SQL has them.) Short documents
have noisy histograms; a minimum length guards each comparison.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worktrace.llm.common import WORD, lookup_join, materialise, packed, quoted, small_batches

# Frequent function words of the languages. Of any other language the most
# frequent words of its documents take their place, see vocabulary().
COMMON_WORDS = {
    "en": "the of and to in is that for with as was on be by this are at from or an have not it you".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au avec plus ne se pas ce".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero".split(),
}
#: Bins of the common-word histogram; one more counts all other words.
VOCABULARY = list(dict.fromkeys(w for words in COMMON_WORDS.values() for w in words))
#: Marks stripped from both ends of a word before it is looked up.
MARKS = ".,;:!?\"'()"
#: Bins of the character histogram: ASCII characters by class, others by the scripts' ranges of code
#: points; one more counts all other characters.
CLASSES = {
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "space": " \t\n\v\f\r",
    "mark": ".,;:!?\"'()-",
    "symbol": "#*$%&|<>",
}
SCRIPTS = {
    "latin": [(0x80, 0x2AF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "semitic": [(0x590, 0x8FF), (0xFB1D, 0xFDFF), (0xFE70, 0xFEFF)],
    "indic": [(0x900, 0xDFF)],
    "southeast": [(0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF)],
    "punctuation": [(0x2000, 0x206F), (0x3000, 0x303F)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x2E80, 0x2FDF), (0x3400, 0x9FFF), (0x20000, 0x323AF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
}
BINS = len(CLASSES) + len(SCRIPTS) + 1

MIN_WORDS = 10  # base rule
MAX_REPEAT_PERCENT = 20  # base rule
WINDOW = 5
MIN_CLASS_CHARS = 200  # below, the character histogram is not compared
MIN_COMMON_WORDS = 100  # below, the common-word histogram is not compared
MIN_REFERENCE_WORDS = 1000  # below, the language has no reference
MAX_CLASS_DISTANCE = 0.30
#: The common-word histogram of n words may be this far off: a constant, and its
#: sampling noise, which falls with the root of n.
MAX_COMMON_DISTANCE = 0.22
COMMON_NOISE = 1.4
#: Bounds around robust references: a constant, and sampling noise of n characters or words.
MAX_CLASS_SPREAD = 0.12
CLASS_SPREAD_NOISE = 1.0
MAX_COMMON_SPREAD = 0.06
COMMON_SPREAD_NOISE = 3.0
SHARE_DIGITS = 4  # of the shares whose medians are taken, so that each bin has few values to count

_WORD = re.compile(WORD)
_FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, classes array<long>, common array<long>"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """The class of each ASCII character; from which code points on others are of which class; the bins of the fixed words in any case."""
    of_ascii = np.full(128, BINS - 1, dtype=np.int64)
    for k, chars in enumerate(CLASSES.values()):
        of_ascii[[ord(c) for c in chars]] = k
    ranges = sorted((a, b, len(CLASSES) + k) for k, spans in enumerate(SCRIPTS.values()) for a, b in spans)
    edges = [(0, BINS - 1), *(e for a, b, k in ranges for e in ((a, k), (b + 1, BINS - 1)))]
    last = dict(edges)  # a range that begins where another ends wins
    last |= {a: k for a, _, k in ranges}
    points = np.array(sorted(last), dtype=np.uint32)
    spellings = {"".join(s): i for i, w in enumerate(VOCABULARY) for s in product(*({c, c.upper()} if c.isascii() else {c} for c in w))}
    return of_ascii, points, np.array([last[p] for p in points.tolist()], dtype=np.int64), spellings


def character_classes(text: str) -> np.ndarray:
    """The histogram of a text's characters."""
    of_ascii, edges, of_range, _ = _tables()
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    low = points < 128
    if low.all():
        return np.bincount(of_ascii[points], minlength=BINS)
    high = of_range[np.searchsorted(edges, points[~low], side="right") - 1]
    return np.bincount(of_ascii[points[low]], minlength=BINS) + np.bincount(high, minlength=BINS)


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """How many words lie in a window of `window` words that the text holds twice or more."""
    spans = list(zip(*(words[k:] for k in range(window)), strict=False))
    if len(set(spans)) == len(spans):
        return 0
    counts = Counter(spans)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for i, s in enumerate(spans):
        if counts[s] > 1:
            covered[i] += 1
            covered[min(i + window, len(words))] -= 1
    return int((np.cumsum(covered[:-1]) > 0).sum())


def measure(text: str | None, own: Sequence[str] | None = None) -> tuple:
    """The features of one whole text (None: empty). own: the common words of its language, if it has none of the fixed ones."""
    text = text or ""
    words = _WORD.findall(text)
    classes = character_classes(text)
    spaces, symbols = list(CLASSES).index("space"), list(CLASSES).index("symbol")
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    bare, index = [w.strip(MARKS) for w in words], _tables()[3]
    if own is not None:
        bare, index = [w.translate(_LOWER) for w in bare], {w: k for k, w in enumerate(own)}
    common = [0] * (len(VOCABULARY) + 1)
    for k, n in Counter(map(index.get, bare)).items():
        common[-1 if k is None else k] = n
    n_chars = int(classes.sum())
    return (
        len(words), n_chars - int(classes[spaces]), int(classes[symbols]), len(lines) - len(set(lines)), repeated_words(words),
        n_chars, classes.tolist(), common,
    )


def _measured(texts: pa.Array, own: pa.Array | None = None) -> pa.Array:
    rows = [measure(t.as_py(), None if own is None else own[i].as_py()) for i, t in enumerate(texts)]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
    kinds = [pa.int64()] * 6 + [pa.list_(pa.int64())] * 2
    names = [f.split()[0] for f in _FEATURES.split(", ")]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _measured_alone(texts: pa.Array) -> pa.Array:
    return _measured(texts)


def _measured_with(texts: pa.Array, own: pa.Array) -> pa.Array:
    return _measured(texts, own)


def vocabulary(docs: DataFrame, text: Column, lang: Column, size: int = len(VOCABULARY)) -> DataFrame:
    """lang -> own: the most frequent words of each language that COMMON_WORDS lacks, over all its documents (null is a language).

    Words are bare of MARKS, with A-Z lowered; of equally frequent ones the first
    in order. A language's words are ranked in parts, then the best of each.
    """
    other = docs.select(lang.alias("lang"), text.alias("t")).filter(~F.coalesce(F.col("lang").isin(*COMMON_WORDS), F.lit(False)))
    word = F.translate(F.btrim("w", F.lit(MARKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = other.select("lang", F.explode(F.split("t", r"[\x20\x09-\x0D]+")).alias("w")).select("lang", word.alias("w")).filter("w <> ''")
    best = words.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    for keys in (["lang", F.pmod(F.xxhash64("w"), F.lit(64))], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "w")
        best = best.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= size)
    own = best.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "w"))).alias("own"))
    return own.select("lang", F.transform("own", lambda x: x["w"]).alias("own"))


def measured(docs: DataFrame, text_col: str, lang_col: str, **more: Column) -> DataFrame:
    """`docs` as lang, _f (measure() of the text), and more columns, written to the shared folder. Texts are measured once."""
    small_batches(docs.sparkSession)
    text, lang = quoted(text_col), quoted(lang_col)
    rows = docs.select(lang.alias("lang"), text.alias("_text"), *[c.alias(name) for name, c in more.items()])
    others = docs.select(lang.alias("lang")).filter(~F.coalesce(F.col("lang").isin(*COMMON_WORDS), F.lit(False)))
    if others.isEmpty():
        feature = F.arrow_udf(_measured_alone, _FEATURES)("_text")
    else:
        own = materialise(vocabulary(docs, text, lang), "quality-vocabulary")
        rows = lookup_join(rows, own, ["lang"], F.xxhash64("_text"))
        fixed = F.coalesce(F.col("lang").isin(*COMMON_WORDS), F.lit(False))
        feature = F.arrow_udf(_measured_with, _FEATURES)("_text", F.when(~fixed, F.coalesce("own", F.array().cast("array<string>"))))
    return materialise(rows.select("lang", feature.alias("_f"), *more), "quality-rows")


def _base_failed(f: str = "_f") -> Column:
    n, repeat = F.col(f"{f}.n_words"), F.col(f"{f}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)


def references(featured: DataFrame) -> DataFrame:
    """lang -> the summed histograms (classes, common) of its documents that pass the base rules.

    `featured`: rows with lang and the struct _f. Languages of fewer than
    MIN_REFERENCE_WORDS words have no reference. Null is a language of its own.
    """
    sums = [F.sum(F.col("_f.classes")[i]).alias(f"c{i}") for i in range(BINS)]
    sums += [F.sum(F.col("_f.common")[i]).alias(f"w{i}") for i in range(len(VOCABULARY) + 1)]
    by = featured.filter(~_base_failed()).groupBy("lang").agg(
        F.sum("_f.n_words").alias("ref_words"), F.sum("_f.n_chars").alias("ref_chars"), *sums,
    ).filter(F.col("ref_words") >= MIN_REFERENCE_WORDS)
    return by.select(
        "lang",
        "ref_words",
        "ref_chars",
        F.array(*[f"c{i}" for i in range(BINS)]).alias("ref_classes"),
        F.array(*[f"w{i}" for i in range(len(VOCABULARY) + 1)]).alias("ref_common"),
    )


def centres(featured: DataFrame) -> DataFrame:
    """lang -> the median share of each bin over its documents that pass the base rules and are long enough, in the columns of references().

    The medians are exact over rounded shares, whose counts combine map-side.
    """

    def medians(name: str, bins: int, total: str, least: int) -> list[Column]:
        share = lambda i: F.round(F.col(f"_f.{name}")[i] / F.col(f"_f.{total}"), SHARE_DIGITS)
        return [F.median(F.when(F.col(f"_f.{total}") >= least, share(i))).alias(f"{name}{i}") for i in range(bins)]

    kinds = {"classes": (BINS, "n_chars", MIN_CLASS_CHARS), "common": (len(VOCABULARY) + 1, "n_words", MIN_COMMON_WORDS)}
    by = featured.filter(~_base_failed()).groupBy("lang").agg(
        *[m for name, (bins, total, least) in kinds.items() for m in medians(name, bins, total, least)]
    )
    by = by.select("lang", *[F.array(*[f"{name}{i}" for i in range(bins)]).alias(f"ref_{name}") for name, (bins, _, _) in kinds.items()])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return by.select("lang", total("ref_common").alias("ref_words"), total("ref_classes").alias("ref_chars"), "ref_classes", "ref_common")


def robust_references(featured: DataFrame) -> DataFrame:
    """references() over the documents near their language's centres only.

    `featured` is read several times, so it should be materialised. A language of
    which too few words are near its centres has the sums over all its documents
    that pass the base rules.
    """
    near = judged(featured, materialise(centres(featured), "quality-centres")).filter("kept").select("lang", "_f")
    trimmed = materialise(references(near), "quality-trimmed")
    known = trimmed.select(F.col("lang").alias("_known"))
    return trimmed.unionByName(references(featured).join(known, F.col("lang").eqNullSafe(F.col("_known")), "left_anti"))


def distance(counts: Column, total: Column, reference: Column, ref_total: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms of counts with their totals; null if either is empty."""

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    terms = F.zip_with(counts, reference, lambda a, b: (lambda p, q: part(p, q) + part(q, p))(a / total.cast("double"), b / ref_total.cast("double")))
    divergence = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2
    return F.when((total > 0) & (ref_total > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def judged(featured: DataFrame, refs: DataFrame, robust: bool = True) -> DataFrame:
    """`featured` with base_failed, class_distance, common_distance (null: too short, or no reference) and kept."""
    if robust:
        class_bound, common_bound = MAX_CLASS_SPREAD + CLASS_SPREAD_NOISE / F.sqrt("_f.n_chars"), MAX_COMMON_SPREAD + COMMON_SPREAD_NOISE / F.sqrt("_f.n_words")
    else:
        class_bound, common_bound = F.lit(MAX_CLASS_DISTANCE), MAX_COMMON_DISTANCE + COMMON_NOISE / F.sqrt("_f.n_words")
    rows = lookup_join(featured, refs, ["lang"], F.xxhash64("_f.n_chars", "_f.word_chars", "_f.n_words"))
    rows = rows.withColumn(
        "class_distance",
        F.when(F.col("_f.n_chars") >= MIN_CLASS_CHARS, distance(F.col("_f.classes"), F.col("_f.n_chars"), F.col("ref_classes"), F.col("ref_chars"))),
    )
    rows = rows.withColumn(
        "common_distance",
        F.when(F.col("_f.n_words") >= MIN_COMMON_WORDS, distance(F.col("_f.common"), F.col("_f.n_words"), F.col("ref_common"), F.col("ref_words"))),
    )
    far = F.coalesce(F.col("class_distance") > class_bound, F.lit(False)) | F.coalesce(F.col("common_distance") > common_bound, F.lit(False))
    return rows.withColumn("base_failed", _base_failed()).withColumn("kept", ~F.col("base_failed") & ~far).drop(
        "ref_classes", "ref_common", "ref_chars", "ref_words",
    )


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", robust: bool = True,
    references_of: DataFrame | None = None
) -> DataFrame:
    """One row per row of `docs`: doc_id, the base counts, base_failed, kept, class_distance, common_distance.

    Null or empty text has no words and fails the base rule. Texts are read whole,
    once: their counts are written to the shared folder and feed both the
    references and the verdicts. Repeated rows count each time. Empty table: no
    rows. Other columns are ignored, whatever their names.

    references_of: documents (the same columns) to take the references from, in
    place of `docs`; the four fixed languages only, whose bins don't depend on them.
    """
    rows = measured(docs, text_col, lang_col, doc_id=quoted(id_col))
    out = judged(rows, _references(rows, text_col, lang_col, robust, references_of), robust)
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *[f"_f.{c}" for c in base], "base_failed", "kept", "class_distance", "common_distance")


def _references(rows: DataFrame, text_col: str, lang_col: str, robust: bool, references_of: DataFrame | None) -> DataFrame:
    rows = rows.select("lang", "_f")
    if references_of is not None:
        given = references_of.filter(quoted(lang_col).isin(*COMMON_WORDS))
        rows = measured(given, text_col, lang_col)
    return materialise(robust_references(rows) if robust else references(rows), "quality-references")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", references_of: DataFrame | None = None) -> DataFrame:
    """The rows of `docs` that score() keeps, with all their columns.

    Texts are measured once: rows are written to the shared folder with their
    counts, which feed both the references and the verdicts. Null and empty texts
    go, repeated rows each get the same verdict, an empty table gives no rows.
    """
    rows = measured(docs, text_col, lang_col, _row=packed(docs))
    refs = _references(rows, text_col, lang_col, True, references_of)
    return judged(rows, refs).filter("kept").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
