"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a piece BPE (B) end together, and how often in the whole corpus.

Both tokenizers see the text behind one space. The ends of their tokens are running sums of byte lengths; ends that both have cut
the tokens into groups, and two tokens are linked where their bytes end together. No token of either goes on from a character that is no white space
into a space, so a text is first cut at its single spaces: the stretches are encoded on their own, once a block of rows, and what is found for one
holds wherever it comes. (`Tokenizers.separable` tells whether the vocabularies allow it; else the whole text is one stretch.)

Pass one writes, for each block of rows, its documents and how often the block holds each pair of ids. Counts are added up by pair and a salt, then by
pair; each pair learns whether it is its B id's most frequent one. Pass two brings these back to the blocks, where documents sum them up.

Defined results: texts that are null, empty or not told back byte by byte by both tokenizers (those with U+2581, which B writes
for a space) have no tokens: zeros and ''. Very long texts are whole; repeated rows count and come again; a null doc_id
stays null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docnav.llm.common import Scratch, block_values, bounded_batches, in_blocks, load, only_chunk, packed, unpacked
from docnav.llm.op4_bpe import byte_letters

#: Bytes of text in a block, and stretches that B encodes at once.
BLOCK, AT_ONCE = 1 << 20, 4000
SALTS = 16
MARK, NEWER = "\u2581", "\u0530"
# Fixed value: the pattern by which byte-level BPE cuts texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
_UNEVEN = re.compile(r"\s\s|^\s|\s$")

DOCS = "array<struct<doc_id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string>>"
BLOCKS = f"block long, docs {DOCS}, items binary, links binary, pairs array<long>, times array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def tokenizer_paths() -> tuple[str, str]:
    folder = "/opt/tokenizers"
    if folder not in sys.path:
        sys.path.append(folder)
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """Both tokenizers with the bytes of their ids. Letters known to every version of Unicode tables (below U+0530) are encoded by ranks, which is faster;
    A's library encodes the rest."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        with open(path_a, encoding="utf-8") as f:
            file = json.load(f)
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        own = file["model"]["vocab"]
        ranks = {self.bytes_a[i]: i for i in own.values()}
        cut = (file.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and file["pre_tokenizer"].get("use_regex", True) and not file["pre_tokenizer"].get("add_prefix_space") and not file.get("normalizer")
        self.ranks = None
        if cut and all(own[x + y] == 256 + i for i, (x, y) in enumerate(merges)):
            ordered = {t: i for t, i in ranks.items() if i < 256 + len(merges)}
            self.ranks = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ordered, special_tokens={})
        inside = re.compile(f"[^{MARK}]{MARK}")
        self.separable = cut and not any(inside.search(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.name_a, self.name_b = ([str(i) for i in range(len(t))] for t in (self.bytes_a, self.bytes_b))

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode()

    def _encode_a(self, text: str) -> list[int]:
        if self.ranks and max(text) < NEWER:
            return self.ranks.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def encode(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and B for the stretches end to end, each behind a space, and the bytes of each stretch. Those that are told back wrongly have no ids and
        -1 bytes."""
        got_a, got_b, size = [], [], np.empty(len(stretches), np.int64)
        joined, plain = [], []
        for i, s in enumerate(stretches):
            # white space at an end would meet its neighbour's
            (joined if self.separable and s and not s[0].isspace() and not s[-1].isspace() else plain).append(i)
        order, at = [[i] for i in plain], []
        for k in range(0, len(joined), AT_ONCE):
            part = joined[k : k + AT_ONCE]
            usual = [i for i in part if max(stretches[i]) < NEWER]
            order += [x for x in (usual, [i for i in part if max(stretches[i]) >= NEWER]) if x]
        while order:
            part = order.pop()
            text = " ".join(stretches[i] for i in part)
            whole = f" {text}".encode()
            a, b = self._encode_a(" " + text), self.b.encode(text)
            if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
                if len(part) > 1:
                    order += [part[: len(part) // 2], part[len(part) // 2 :]]
                else:
                    size[part[0]] = -1
                    at.append(part[0])
                continue
            got_a.append(a)
            got_b.append(b)
            for i in part:
                size[i] = 1 + len(stretches[i].encode())
            at += part
        ids = [np.fromiter((x for g in got for x in g), np.int64, sum(map(len, got))) for got in (got_a, got_b)]
        return *ids, np.array(at, np.int64), size


@cache
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the ends of two token sequences over the same bytes: the common cuts, the group of each A and each B token, and the places (in A, in B) of the
    linked tokens."""
    cuts = np.intersect1d(ends_a, ends_b)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    first = np.searchsorted(ends_b, ends_a)
    many = np.searchsorted(ends_b, ends_a, "right") - first
    left = np.repeat(np.arange(len(ends_a)), many)
    right = np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(left))
    return cuts, group_a, group_b, left, right


class Aligned:
    """What is found for distinct stretches: for each the numbers of tokens, groups and links, its groups written out, and its links' pairs
    (from ``start`` on, in ``pair``); ``good`` tells those that are told back."""

    def __init__(self, t: Tokenizers, stretches: list[str]):
        a, b, at, size = t.encode(stretches)
        n = len(stretches)
        self.good = size >= 0
        at = at[size[at] >= 0]  # stretches in the order in which their tokens lie
        ends = np.cumsum(size[at])
        ends_a, ends_b = np.cumsum(t.size_a[a]), np.cumsum(t.size_b[b])
        cuts, group_a, group_b, left, right = align(ends_a, ends_b)
        upto = [np.searchsorted(x, ends, "right") for x in (ends_a, ends_b, cuts, ends_a[left])]
        self.n_a, self.n_b, self.n_groups, self.n_links = (self._per(at, u, n) for u in upto)
        self.start = np.zeros(n, np.int64)
        self.start[at] = upto[3] - self.n_links[at]
        self.pair = a[left] * len(t.bytes_b) + b[right]
        self.text = self._written(t, a, b, group_a, group_b, at, upto, n)

    @staticmethod
    def _per(at: np.ndarray, upto: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[at] = np.diff(upto, prepend=0)
        return out

    @staticmethod
    def _written(t: Tokenizers, a, b, group_a, group_b, at, upto, n) -> list[str]:
        last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (group_a, group_b))
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        marks = np.empty(len(a) + len(b), object)
        marks[place_a] = [t.name_a[i] + ("|" if x else ",") for i, x in zip(a.tolist(), last_a.tolist(), strict=True)]
        marks[place_b] = [t.name_b[i] + (";" if x else ",") for i, x in zip(b.tolist(), last_b.tolist(), strict=True)]
        marks, out, k = marks.tolist(), [""] * n, 0
        for i, e in zip(at.tolist(), (upto[0] + upto[1]).tolist(), strict=True):
            out[i] = "".join(marks[k:e])
            k = e
        return out


def _marked(text: str, separable: bool) -> str:
    """The text with MARK for the spaces at which it is cut."""
    if not separable:
        return text
    return _SINGLE.sub(MARK, text) if _UNEVEN.search(text) else text.replace(" ", MARK)


def _blocks(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(*paths)
        for number, block in in_blocks(batches, BLOCK):
            ids, texts = block.column("doc_id").to_pylist(), only_chunk(block.column("text")).to_pylist()
            use = [bool(x) and MARK not in x for x in texts]
            parts = pc.split_pattern(pa.array([_marked(x, t.separable) for x, u in zip(texts, use, strict=True) if u], pa.string()), MARK)
            coded = parts.flatten().dictionary_encode()
            found = Aligned(t, coded.dictionary.to_pylist())
            number_of, offsets = np.asarray(coded.indices, np.int64), np.asarray(parts.offsets, np.int64)
            used = np.flatnonzero(use)
            good = np.array([bool(found.good[number_of[i:j]].all()) for i, j in zip(offsets[:-1], offsets[1:], strict=True)], bool)
            docs, owner = [(i, 0, 0, 0, 0, "") for i in ids], np.repeat(used, np.diff(offsets))
            keep = np.repeat(good, np.diff(offsets))
            for d, i, j, fine in zip(used.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), good.tolist(), strict=True):
                if fine:
                    own = number_of[i:j]
                    written = "".join(map(found.text.__getitem__, own.tolist()))[:-1]
                    docs[d] = (ids[d], *(int(x[own].sum()) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)), hashlib.sha256(written.encode()).hexdigest())
            width = max(1, len(found.good))
            item, times = np.unique(owner[keep] * width + number_of[keep], return_counts=True)
            # the pairs of stretches that documents with tokens hold, each with its occurrences in the block
            held = np.bincount(number_of[keep], minlength=width)[: len(found.good)]
            order = np.repeat(found.start, found.n_links) + np.arange(int(found.n_links.sum())) - np.repeat(np.cumsum(found.n_links) - found.n_links, found.n_links)
            pairs, place = np.unique(found.pair[order], return_inverse=True)
            many = np.zeros(len(pairs), np.int64)
            np.add.at(many, place, np.repeat(held, found.n_links))
            fields = [pa.array(x, k) for x, k in zip(zip(*docs, strict=True), [pa.int64()] * 5 + [pa.string()], strict=True)]
            docs = pa.StructArray.from_arrays(fields, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            row = [
                pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), pa.array([packed(item // width, item % width, times)], pa.binary()),
                pa.array([packed(found.n_links, place)], pa.binary()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64())) for x in (pairs, many)),
            ]
            yield pa.RecordBatch.from_arrays(row, ["block", "docs", "items", "links", "pairs", "times"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of blocks whose pairs have come back with their counts."""
    for batch in batches:
        for r in range(batch.num_rows):
            docs = batch.column("docs").slice(r, 1).flatten()
            found = batch.column("found").slice(r, 1).flatten()
            count, best = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
            if len(found):
                pos, n, top = (found.field(i) for i in range(3))
                count[np.asarray(pos)] = np.asarray(pc.fill_null(n, 0))
                best[np.asarray(pos)] = np.asarray(pc.fill_null(top, False).cast(pa.int64()))
            owner, stretch, times = unpacked(batch.column("items")[r].as_py())
            n_links, place = unpacked(batch.column("links")[r].as_py())
            of = np.repeat(np.arange(len(n_links)), n_links)
            per_stretch = [np.zeros(len(n_links), np.int64) for _ in range(2)]
            per_doc = [np.zeros(len(docs), np.int64) for _ in range(2)]
            for s, d, x in zip(per_stretch, per_doc, (best, count), strict=True):
                np.add.at(s, of, x[place])
                np.add.at(d, owner, times * s[stretch])
            own = [docs.field(i) for i in range(6)]
            yield pa.RecordBatch.from_arrays([*own[:5], pa.array(per_doc[0]), pa.array(per_doc[1]), own[5]], [x.split()[0] for x in RESULT.split(", ")])


def pair_counts(blocks: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best): links of each pair of ids in the corpus, and whether no other pair of its B id has more. A B id has as many pairs as A has ids
    at most."""
    each = blocks.select("block", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select(F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"), F.pmod(F.hash("block"), F.lit(SALTS)).alias("salt"))
    summed = each.groupBy("pair", "salt").agg(F.sum("times").alias("times")).groupBy("pair").agg(F.sum("times").alias("count")).where("count > 0")
    b = summed.withColumn("b", F.col("pair") % size_b)
    most = b.groupBy("b").agg(F.max("count").alias("most"))
    return b.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, paths: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents with their digests and sums (RESULT), and the pairs of ids with their counts."""
    spark, paths = docs.sparkSession, paths or tokenizer_paths()
    bounded_batches(spark)
    scratch = Scratch(spark)
    blocks = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_blocks(paths), BLOCKS))
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size()
    counts = scratch.keep(pair_counts(blocks, size_b))
    found = block_values(blocks, "pairs", counts, "pair")
    rows = blocks.select("block", "docs", "items", "links").join(found, "block", "left").select("docs", "items", "links", "found")
    pairs = counts.select(F.expr(f"pair div {size_b}").alias("a"), (F.col("pair") % size_b).alias("b"), "count", "best")
    return rows.mapInArrow(_summed, RESULT), pairs


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(load(spark, sf_dir, "documents"))[0]
