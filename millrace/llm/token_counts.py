"""Token counts with a digest cache.

A text is known by the SHA-256 of its content, a tokenizer by the SHA-256 of its file. Counts are
stored under both digests as Parquet in a folder that all executors share. A run joins the digests
of its texts to the stored counts, encodes one copy of each distinct text that is missing, appends
those counts and joins them to every document. Only digests and ids are grouped; of the texts one
copy each is moved, by (digest, id), so a text that a third of the rows share is no hot key.

Inside a task the encoder remembers the counts of single words: byte-level BPE with the usual split
pattern never joins a character to a blank that follows it, so a text can be cut before every blank
that stands between two other characters, and the counts add up. Other tokenizers get whole texts.

Defined cases: NULL counts as the empty text (0 tokens); rows with equal or NULL ids each keep their
own row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, text_of
from millrace.session import materialize, scratch_path, session_of

WORDS_KEPT = 400_000


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _splits_at_blanks(path: str) -> bool:
    """True for byte-level BPE files whose tokens never span a character and a later blank."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    first = parts.get("pre_tokenizer") or {}
    plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
    stripping = any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in parts.get("added_tokens", []))
    return bool(plain and parts.get("normalizer") is None and not stripping)


class Encoder:
    """Counts tokens of texts with the library that the file's kind asks for."""

    def __init__(self, path: str):
        self.by_word = False
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.by_word = _splits_at_blanks(path)
            self._sizes: Callable[[list[str]], list[int]] = lambda texts: [
                len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self._sizes = lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
        self._words: dict[str, int | None] = {}

    def counts(self, texts: list[str]) -> list[int]:
        return [self._by_words(t) for t in self._learn(texts)] if self.by_word else self._sizes(texts)

    def _learn(self, texts: list[str]) -> Iterable[list[str]]:
        cut = [text.split(" ") for text in texts]
        if len(self._words) > WORDS_KEPT:
            self._words.clear()
        fresh = [w for w in set().union(*(c[1:] for c in cut)) - self._words.keys()]
        # a blank next to other white space is no safe place to cut: such texts take the careful path
        unsafe = {w for w in fresh if not w or w[0].isspace() or w[-1].isspace()}
        self._words.update(dict.fromkeys(unsafe))
        safe = [w for w in fresh if w not in unsafe]
        self._words.update(zip(safe, self._sizes([" " + w for w in safe])))
        return cut

    def _by_words(self, words: list[str]) -> int:
        head = words[0]
        if head and not head[-1].isspace():
            try:
                return self._sizes([head])[0] + sum(map(self._words.__getitem__, words[1:]))
            except TypeError:
                pass
        chunks = re.split(r"(?<=\S)(?= \S)", " ".join(words))
        return sum(self._sizes(chunks)) if chunks != [""] else 0


def count_texts(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(content, n_tokens) of the rows (content, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                sizes = encoder.counts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("content"), pa.array(sizes, pa.int64())], names=["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(run, "content string, n_tokens long")


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text).

    ``tokenizer`` is a file that every machine has at the same path; ``cache`` is a folder of stored
    counts (a new one per call if not given) and is extended by this call.
    """
    spark = session_of(docs)
    version = tokenizer_digest(tokenizer)
    cache = cache or scratch_path(spark, "token-counts")
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("content", F.sha2("text", 256))
    distinct = rows.groupBy("content").agg(F.min("doc_id").alias("pick"))
    empty = spark.createDataFrame([], "tokenizer string, content string, n_tokens long")
    empty.write.mode("append").parquet(cache)

    def stored() -> DataFrame:
        table = spark.read.schema(empty.schema).parquet(cache).where(F.col("tokenizer") == version)
        return table.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    misses = distinct.join(stored().select("content"), "content", "left_anti").withColumnRenamed("content", "wanted")
    # both columns are join keys, so copies of one text are dealt out by their ids
    once = rows.join(misses, (F.col("content") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("pick")), "left_semi")
    fresh = count_texts(once, tokenizer).withColumn("tokenizer", F.lit(version))
    fresh.select("tokenizer", "content", "n_tokens").write.mode("append").parquet(cache)
    counts = spark.read.schema(empty.schema).parquet(cache).where(F.col("tokenizer") == version)
    # written out first, so the join below deals out both sides itself and Spark can split a hot digest
    sizes = materialize(counts.select("content", "n_tokens").dropDuplicates(["content"]))
    light = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
    return light.join(sizes, "content", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
