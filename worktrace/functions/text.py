"""Text expressions: clean-up, measurements, keywords, descriptions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# A number, a unit, the keywords in their order, the domain's labels, and below the
# texts of descriptions and triggers.
NUMBER = r"(?:\b\d+\.?\d*|\b(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|twenty|thirty|forty|fifty|quarter|half|hundred))"
UNIT = (
    r"(?:ft[-\s]?lb|foot[-\s]?pound|n[-\s]?m|newton[-\s]?meter|mm|cm|inch(?:es)?|in\b|rpm|degree|°[cCfF]|bar|psi|"
    r"kg|kilogram|pound(?:s)?|lb(?:s)?\b|torque|kpa|mpa|cc|liter)"
)
KEYWORDS = [
    "first", "then", "next", "after that", "careful", "always", "never",
    "make sure", "important", "trick", "key", "remember", "critical",
    "must", "ensure", "verify", "note that", "be sure", "check",
    "먼저", "다음", "그다음", "주의", "항상", "절대", "중요", "반드시",
    "확인", "포인트", "비결", "핵심", "조심", "꼭", "우선",
]
DOMAIN_LABELS = ["person", "car", "truck", "motorcycle", "bicycle", "bus", "scissors", "knife", "bottle", "cell phone", "laptop", "clock"]

MEASUREMENT = f"(?U)(?i){NUMBER}\\s*{UNIT}"


def _ascii(pattern: str) -> str:
    """The pattern with the classes of RE2, whose words, digits and white space are ASCII (a word may begin behind an accented letter); s and k have a third form each."""
    word = "[0-9A-Za-z_]"
    bound = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    for old, new in ((r"[-\s]", "[- \t\n\f\r]"), (r"\s", "[ \t\n\f\r]"), (r"\d", "[0-9]"), ("s", "[s\u017f]"), ("k", "[k\u212a]"), (r"\b", bound)):
        pattern = pattern.replace(old, new)
    return pattern


ASCII_MEASUREMENT = f"(?i){_ascii(NUMBER)}{_ascii(chr(92) + 's*')}{_ascii(UNIT)}"


#: White space of any script.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ASCII_WHITE = "\t\n\x0c\r "


def strip(text: Column, ascii_classes: bool = False) -> Column:
    """Without white space at both ends: that of any script, or that of RE2's classes alone, as in the SQL of the queries."""
    return F.btrim(text, F.lit(ASCII_WHITE if ascii_classes else WHITE))


def measurements(text: Column, ascii_classes: bool = False) -> Column:
    """All number-and-unit phrases of a text, in order. Words, digits and white space are Unicode's, or those of ASCII alone, as in the SQL of the queries."""
    return F.regexp_extract_all(text, F.lit(ASCII_MEASUREMENT if ascii_classes else MEASUREMENT), F.lit(0))


def keywords(text: Column) -> Column:
    """The keywords that the lower-cased text contains anywhere, in the order of the list."""
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(k) for k in KEYWORDS]), lambda k: F.contains(low, k))


def domain_labels(labels: Column) -> Column:
    """The labels that matter to the domain; order and repeats stay."""
    return F.filter(labels, lambda x: x.isin(*DOMAIN_LABELS))


def list_text(items: Column) -> Column:
    """A list of strings as Python shows it; white space other than the space is written as its escape."""
    shown = F.array_join(items, "', '")
    for raw, escape in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\x0b", "\\x0b"), ("\x0c", "\\x0c"), ("\xa0", "\\xa0"), ("　", "\\u3000")):
        shown = F.replace(shown, F.lit(raw), F.lit(escape))
    return F.when(F.size(items) > 0, F.concat(F.lit("['"), shown, F.lit("']"))).otherwise("[]")


def _one_decimal(ms: pa.Array) -> pa.Array:
    return pa.array([None if v is None else f"{v / 1000:.1f}" for v in ms.to_pylist()], pa.string())


def one_decimal(ms: Column) -> Column:
    """Milliseconds as seconds with one decimal, rounded from the binary number as Python does (Spark rounds the decimal text)."""
    return F.arrow_udf(_one_decimal, "string")(ms)


def _hand(active: Column) -> Column:
    return F.when(active, ", 손 동작 활성").otherwise("")


def describe(kind: Column, ts_ms: Column, hits: Column, hand_active: Column) -> Column:
    """The description of a highlight; at most three hits are named."""
    at = F.concat(F.lit("["), one_decimal(ts_ms), F.lit("초] "))
    some = F.slice(hits, 1, 3)
    return (
        F.when(kind == "measurement_speech", F.concat(at, F.lit("정비 수치 발화 감지 — "), F.array_join(some, " / "), F.lit(" 언급"), _hand(hand_active)))
        .when(kind == "procedural_speech", F.concat(at, F.lit("작업 절차/주의사항 발화 — 키워드: "), F.array_join(some, ", "), _hand(hand_active)))
        .when(kind == "tool_active_speech", F.concat(at, F.lit("작업 중 발화 감지 — 감지 객체: "), F.array_join(some, ", "), _hand(hand_active)))
        .when(kind == "active_hands", F.concat(at, F.lit("발화 없는 손 작업 집중 구간")))
    )


def trigger(kind: Column, hits: Column) -> Column:
    """Why a highlight was raised."""
    return (
        F.when(kind == "measurement_speech", F.concat(F.lit("수치 단위 발화: "), list_text(hits)))
        .when(kind == "procedural_speech", F.concat(F.lit("절차 키워드 발화: "), list_text(hits)))
        .when(kind == "tool_active_speech", F.concat(F.lit("작업 중 발화: "), list_text(hits)))
        .when(kind == "active_hands", F.lit("손 동작 감지 (비음성 구간)"))
    )


def artefact_stem(path: Column) -> Column:
    """The video's name in a document's path. Names repeat across folders: the full path is the key."""
    return F.regexp_extract(path, r"([^/]+?)(_features|_insights)?\.json$", 1)
