"""Token counts with the whole-token shortcut.

Which vocabulary strings encode alone as one token is proven once, before the
job (`tokens.whole_tokens`); the proven set, bounded by the vocabulary, goes to
the workers. A pre-token in it counts one; only the rest is merged.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.llm import tokens
from worktrace.llm.common import quoted, small_batches


def count_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """`docs` with a struct column `_tokens`: n_bytes, n_tokens (long), over_limit (n_tokens > limit).

    Counts are those of the tokenizers library for the whole text, without
    begin, end or added special tokens; special strings inside the text count as
    the library takes them by default. Null or empty text: 0 bytes, 0 tokens. No
    shuffle; rows and their other columns pass through. Empty table: no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    proven = spark.sparkContext.broadcast(tokens.whole_tokens(tokenizer))

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array(_counter(tokenizer, proven).counts(texts.to_pylist()), pa.int64())

    n = counted(quoted(text_col))
    n_bytes = F.coalesce(F.octet_length(quoted(text_col)), F.lit(0)).cast("long")
    out = docs.withColumn("_tokens", F.struct(n_bytes.alias("n_bytes"), n.alias("n_tokens")))
    return out.withColumn("_tokens", F.col("_tokens").withField("over_limit", F.col("_tokens.n_tokens") > limit))


_counters: dict[str, tokens.ByteLevel] = {}


def _counter(path: str, proven) -> tokens.ByteLevel:
    if path not in _counters:
        _counters[path] = tokens.ByteLevel(path, proven.value)
    return _counters[path]
