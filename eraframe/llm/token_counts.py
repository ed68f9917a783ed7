"""Tokens of whole texts, counted without encoding texts: pieces are counted once for each distinct pre-token.

A pre-token is a run of characters that no piece of the model's vocabulary can leave: between two characters that stand
side by side in no piece nothing is ever merged, so a text's pieces are those of its pre-tokens. The pre-tokens of all
texts are gathered with their frequency, counted once each, and joined to the frequencies of each document: the most
frequent ones (at most HEAD, a proven bound) as a broadcast table inside the scan, all others by a shuffled join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, raw_text, text_slices

HEAD = 1 << 17
SLICE = 4 << 20
SPACE = "▁"
ROW = ["key", "doc_id", "n_bytes", "pieces", "token", "f"]


class Counter:
    """Pre-tokens of texts, and their pieces, for a sentencepiece BPE model that keeps texts as they are."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        kinds = spec.SentencePiece
        pieces = [p.piece for p in spec.pieces if p.type == kinds.NORMAL]
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces) or any(p.type == kinds.USER_DEFINED for p in spec.pieces):
            raise ValueError(f"{path}: a BPE model is needed that keeps texts as they are, opens them with a space and has no pieces of its user's")
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        joined = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False)}
        letters = sorted({c for pair in joined for c in pair})
        place = {c: i + 1 for i, c in enumerate(letters)}
        self.kind = np.zeros(0x110000, np.uint16)  # 0: in no piece of several characters
        for c, i in place.items():
            self.kind[ord(c)] = i
        self.kind[32] = place.get(SPACE, 0)
        self.joins = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for a, b in joined:
            self.joins[place[a], place[b]] = True
        # what stands after this character is not merged with what stands before it; its own pieces are taken off again
        self.wall = next(c for c in "\n\r\0" if not self.kind[ord(c)])
        self.own = len(self.model.encode(self.wall, num_threads=1))

    def split(self, text: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pre-tokens of texts (large_string, without nulls), and each text's first one. Not empty texts begin with a space."""
        data, offsets = raw_text(text)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        begin = (data & 0xC0) != 0x80
        begin = np.flatnonzero(begin)  # bytes where characters begin
        code = self.kind[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")]
        cut = np.ones(len(begin), bool)
        if len(begin):
            cut[1:] = ~self.joins[code[:-1], code[1:]]
            cut[np.searchsorted(begin, offsets[:-1][np.diff(offsets) > 0])] = True
        start = begin[cut]
        tokens = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(data))), pa.py_buffer(np.ascontiguousarray(data)))
        return tokens, np.searchsorted(start, offsets)

    def pieces(self, tokens: list[str]) -> list[int]:
        return [len(x) - self.own for x in self.model.encode([self.wall + t for t in tokens], num_threads=1)]


@cache
def counter(path: str) -> Counter:
    """The Counter of a file, one for each Python worker."""
    return Counter(path)


def _distinct(path: str):
    """A slice's different pre-tokens and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, held = counter(path), None
        for batch in text_slices(batches, "text", SLICE):
            tokens, _ = count.split(batch.column(batch.schema.get_field_index("text")))
            coded = tokens.dictionary_encode()
            found = pa.table({"token": coded.dictionary.cast(pa.string()), "f": np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))})
            held = found if held is None else pa.concat_tables([held, found])
            if held.num_rows > 1_000_000:  # sum up what several slices hold
                held = held.group_by("token").aggregate([("f", "sum")]).rename_columns(["token", "f"])
                if held.num_rows > 500_000:
                    yield from held.to_batches(100_000)
                    held = None
        if held is not None:
            yield from held.group_by("token").aggregate([("f", "sum")]).rename_columns(["token", "f"]).to_batches(100_000)

    return run


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            pieces = pa.array(count.pieces(batch.column(0).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pieces], names=["token", "f", "pieces"])

    return run


def _per_document(path: str, head: Broadcast):
    """A row for each text with the pieces of its head pre-tokens, and a row for each other pre-token of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        known, pieces = pa.array(head.value[0], pa.string()), np.array([*head.value[1], 0], np.int64)
        for batch in text_slices(batches, "text", SLICE):
            doc_id, n_bytes, text, key = batch.columns
            tokens, first = count.split(text)
            coded = tokens.dictionary_encode()
            names, ids = coded.dictionary.cast(pa.string()), coded.indices.to_numpy()
            at = pc.fill_null(pc.index_in(names, known), len(known)).to_numpy().astype(np.int64)
            total = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(pieces[at][ids], out=total[1:])
            n = len(text)
            own = [key, doc_id, n_bytes, pa.array(total[first[1:]] - total[first[:-1]]), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(own, names=ROW)
            rare = np.flatnonzero((at == len(known))[ids])
            of = np.searchsorted(first, rare, "right") - 1
            pair, f = np.unique(of * max(1, len(names)) + ids[rare], return_counts=True)
            of, token = np.divmod(pair, max(1, len(names)))
            for i in range(0, len(f), 50_000):
                part = slice(i, i + 50_000)
                n = len(f[part])
                rest = [key.take(pa.array(of[part])), pa.nulls(n, doc_id.type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), names.take(pa.array(token[part])), pa.array(f[part])]
                yield pa.RecordBatch.from_arrays(rest, names=ROW)

    return run


def count_tokens(docs: DataFrame, path: str, head: int = HEAD) -> DataFrame:
    """docs' doc_id with n_bytes (UTF-8) and n_tokens of each whole text; repeated rows each have theirs.

    Null and empty texts have no bytes and no tokens; an empty table gives no rows; other columns don't matter.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    texts = docs.select(docs["doc_id"], F.octet_length(text).cast("long").alias("n_bytes"), F.when(text != "", F.concat(F.lit(" "), F.translate(text, SPACE, " "))).otherwise("").alias("text"))
    found = texts.select("text").mapInArrow(_distinct(path), "token string, f long").groupBy("token").agg(F.sum("f").alias("f"))
    known = materialize(found.mapInArrow(_counted(path), "token string, f long, pieces long"), "pieces")
    # frequencies in classes of an eighth of a doubling: the most frequent classes that together hold at most head
    kinds = known.groupBy(F.floor(F.log2("f") * 8).alias("c")).count().orderBy(F.col("c").desc()).collect()
    within = [r.c for r, total in zip(kinds, accumulate(r["count"] for r in kinds), strict=True) if total <= head]
    first = known.where(F.floor(F.log2("f") * 8) >= within[-1]).select("token", "pieces").toPandas() if within else pd.DataFrame({"token": [], "pieces": []})
    shared = spark.sparkContext.broadcast((first["token"].tolist(), first["pieces"].tolist()))
    keyed = texts.withColumn("key", F.monotonically_increasing_id())
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialize(keyed.mapInArrow(_per_document(path, shared), f"key long, doc_id {kind}, n_bytes long, pieces long, token string, f long"), "frequencies")
    rest = rows.where("token is not null").select("key", "token", "f").join(known.select("token", F.col("pieces").alias("each")), "token")
    rest = rest.select("key", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("long").alias("n_bytes"), (F.col("f") * F.col("each")).alias("pieces"))
    both = rows.where("token is null").select(*rest.columns).unionByName(rest)
    return both.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("pieces").alias("n_tokens")).drop("key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumn("over_limit", F.col("n_tokens") > 4096)
