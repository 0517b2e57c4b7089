"""Encoding of a whole corpus with a public tokenizer: every distinct word is encoded once.

Texts are cut into pre-tokens with their positions, the distinct pre-tokens are gathered by one shuffle and encoded
once each, and their ids are joined back and put together by position.  Joining and putting together stay in the JVM, for
the byte-level ranks cutting too; Python sees only the distinct words.  The other vocabularies cut by their libraries'
own rules.  Vocabulary files are read by the driver and broadcast, so executors need none.  Texts are partitioned by document before they are cut, so the words of a
text never move: with a dictionary small enough to broadcast (its size is measured) the whole encoding takes one
shuffle of texts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.plans.sizing import tasks_for
from orrery.plans.staging import stage

TOKENIZERS = "/opt/tokenizers"
#: fixed value: the public pre-token pattern of the byte-level vocabularies
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DICTIONARY_BYTES = 32 << 20  #: a dictionary above this is joined by a shuffle instead of a broadcast


def vocabulary(name: str, folder: str = TOKENIZERS) -> tuple[str, bytes]:
    """Kind (tiktoken, json or model) and bytes of the vocabulary file of ``name``."""
    for kind in ("tiktoken", "json", "model"):
        if (path := Path(folder) / f"{name}.{kind}").exists():
            return kind, path.read_bytes()
    raise FileNotFoundError(f"{folder}/{name}")


def rank_lines(name: str, folder: str = TOKENIZERS) -> bytes:
    """The vocabulary file ``folder/name.tiktoken``: base64 bytes and id a line."""
    return (Path(folder) / f"{name}.tiktoken").read_bytes()


class _Json:
    """Words and ids by the tokenizers library: its normaliser and cutter give the words, its model encodes each."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(data.decode())

    def words(self, text: str) -> list[str]:
        norm = self.tok.normalizer
        return [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm.normalize_str(text) if norm else text)]

    def ids(self, word: str) -> list[int]:
        return [t.id for t in self.tok.model.tokenize(word)]


class _Model:
    """Words and ids by sentencepiece: no piece holds a blank behind another character, so blanks begin words."""

    blank = "\u2581"

    def __init__(self, data: bytes):
        import re

        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.find = re.compile(f"{self.blank}+[^{self.blank}]*|[^{self.blank}]+").findall

    def words(self, text: str) -> list[str]:
        return self.find(self.sp.normalize(text))

    def ids(self, word: str) -> list[int]:
        if word == self.blank:
            return [self.sp.piece_to_id(word)]
        return self.sp.encode(word.removeprefix(self.blank).replace(self.blank, " "))  # the library puts one blank before


def _library(kind: str, data: bytes) -> _Json | _Model:
    return _Json(data) if kind == "json" else _Model(data)


def _encoding(lines: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _splitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import regex

    find = regex.compile(PATTERN).findall
    for b in batches:
        words = pa.array([find(t) for t in b.column("text").to_pylist()], pa.list_(pa.string()))
        yield pa.record_batch([b.column("doc_id"), words], names=["doc_id", "words"])


def _pretokens(docs: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> list[DataFrame]:
    """Disjoint parts of :func:`pretokens`, each partitioned like ``docs``."""
    docs = docs.select("doc_id", "text").filter("text <> ''")
    kind, data = vocabulary(name, folder)
    if kind != "tiktoken":
        held = docs.sparkSession.sparkContext.broadcast(data)  # one vocabulary file, a few MB

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lib = None
            for b in batches:
                lib = lib or _library(kind, held.value)
                words = pa.array([lib.words(t) for t in b.column("text").to_pylist()], pa.list_(pa.string()))
                yield pa.record_batch([b.column("doc_id"), words], names=["doc_id", "words"])

        return [docs.mapInArrow(cut, "doc_id bigint, words array<string>")]
    unknown = F.col("text").rlike(r"\p{Cn}")
    jvm = docs.filter(~unknown).select("doc_id", F.regexp_extract_all("text", F.lit("(?U)" + PATTERN), F.lit(0)).alias("words"))
    return [jvm, docs.filter(unknown).mapInArrow(_splitter, "doc_id bigint, words array<string>")]


def pretokens(docs: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, words array<string>) of docs(doc_id, text), as the vocabulary cuts them.

    A null or empty text has no words.  For byte-level ranks, texts with characters that the JVM's Unicode tables do not
    know are cut by a newer table in Python, all others in the JVM; both cut whole texts.
    """
    return reduce(DataFrame.unionByName, _pretokens(docs, name, folder))


def dictionary(words: DataFrame, name: str, folder: str = TOKENIZERS) -> DataFrame:
    """(word, ids) of every distinct word of words(word), each encoded once."""
    kind, data = vocabulary(name, folder)
    held = words.sparkSession.sparkContext.broadcast(data)  # one vocabulary file, a few MB

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = None
        for b in batches:
            ids_of = ids_of or (_encoding(held.value).encode_ordinary if kind == "tiktoken" else _library(kind, held.value).ids)
            ids = pa.array([ids_of(w) for w in b.column("word").to_pylist()], pa.list_(pa.int32()))
            yield pa.record_batch([b.column("word"), ids], names=["word", "ids"])

    return words.select("word").distinct().mapInArrow(encode, "word string, ids array<int>")


def _sized(dic: DataFrame) -> DataFrame:
    """Mark a dictionary for broadcast if its measured size allows; a larger one is shuffled, hot words split by AQE."""
    size = dic.agg(F.sum(F.octet_length("word") + 4 * F.size("ids") + 64)).first()[0] or 0
    return F.broadcast(dic) if size <= DICTIONARY_BYTES else dic


def _spread(docs: DataFrame) -> DataFrame:
    """Partition texts by document into enough tasks; no later step moves the words of a text."""
    return docs.select("doc_id", "text").repartition(tasks_for(docs), "doc_id")


def encode(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``documents``; doc_id is unique.

    No special tokens: their strings in a text are ordinary text.  Null and empty texts give an empty list, never
    null.  Other columns are ignored; an empty table gives no rows.
    """
    docs = _spread(documents)
    dic = _sized(stage(dictionary(pretokens(documents, name, folder).select(F.explode("words").alias("word")), name, folder), "words"))
    none = F.array().cast("array<int>")
    out = documents.filter("text IS NULL OR text = ''").select("doc_id", none.alias("ids"))
    for part in _pretokens(docs, name, folder):  # apart, since a union would forget that each is partitioned by document
        at = part.select("doc_id", F.posexplode_outer("words").alias("pos", "word")).join(dic, "word", "left")  # a text may have no word
        parts = at.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("p"))
        out = out.unionByName(parts.select("doc_id", F.coalesce(F.flatten(F.col("p.ids")), none).alias("ids")))
    return out


def decode(encoded: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text) of encoded(doc_id, ids): ids join the token-byte table, bytes are put together by position.

    An empty or null list gives an empty text.  Unknown ids raise an error in the plan.
    """
    spark = encoded.sparkSession
    rows = [(int(i), base64.b64decode(b).hex()) for b, i in map(bytes.split, rank_lines(name, folder).splitlines())]
    tokens = F.broadcast(spark.createDataFrame(rows, "id int, hex string"))  # one row a token of the vocabulary
    encoded = encoded.select("doc_id", "ids").repartition(tasks_for(encoded, 1 << 20), "doc_id")
    at = encoded.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(tokens, "id", "left")
    piece = F.coalesce("hex", F.raise_error(F.lit("unknown token id")).cast("string"))
    parts = at.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", piece.alias("h")))).alias("p"))
    text: Column = F.decode(F.unhex(F.array_join(F.col("p.h"), "")), "UTF-8")
    return encoded.select("doc_id").join(parts.select("doc_id", text.alias("text")), "doc_id", "left").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )


def token_counts(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n bigint): tokens of every text; 0 for null and empty texts."""
    words = pretokens(documents, name, folder)
    dic = stage(dictionary(words.select(F.explode("words").alias("word")), name, folder), "words")
    dic = _sized(dic).select("word", F.size("ids").alias("k"))
    at = pretokens(_spread(documents), name, folder).select("doc_id", F.explode_outer("words").alias("word"))
    n = at.join(dic, "word", "left").groupBy("doc_id").agg(F.coalesce(F.sum("k"), F.lit(0)).cast("bigint").alias("n"))
    none = documents.filter("text IS NULL OR text = ''").select("doc_id", F.lit(0).cast("bigint").alias("n"))
    return n.unionByName(none)
