"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranked, tidy
from .shingles import chunks, text_bytes

LENGTH = 2048
#: Bytes of text cut in words at a time.
CHUNK = 6 << 20

_LETTERS = "a-zA-ZÀ-ÖØ-öø-ſ"
#: What the tokenizer's own splitting does within ASCII and the Latin letters that have one normal form each.
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \t\n\r\f\v{_LETTERS}0-9]+|\n")  # and line feeds, which end the words here
_OTHER = re.compile(r"[^\x00-\x7fÀ-ſ]|<\|")


#: Stands for the end of a word; no UTF-8 text holds this byte.
_END = b"\xff"


def _byte_letters() -> dict[int, int]:
    """The character of each byte in byte-level vocabularies: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


def merges_by_rank(tokenizer_path: str):
    """(bytes of a part -> ranks, ids by rank) of a tokenizer that normalises by NFC, white space and lower case, splits as ``_PARTS`` does, maps bytes to
    characters and merges pairs up to word ends; None if its file says otherwise.

    Such merges can be looked up by the bytes that they give, if each of its tokens is what the merges make of that token alone: merges of lower
    rank than a token's own stay within its bytes wherever it comes about. ``Encoder`` checks that. The first merges join the last byte
    of a word with _END, which the file's vocabulary has as units of their own.
    """
    import tiktoken

    with open(tokenizer_path, encoding="utf-8") as file:
        held = json.load(file)
    kinds = [x["type"] for x in (held.get("normalizer") or {}).get("normalizers", [])]
    steps, model = (held.get("pre_tokenizer") or {}).get("pretokenizers", [{}]), held["model"]
    split = steps[0].get("pattern", {}).get("Regex")
    bytewise = [x["type"] for x in steps[1:]] == ["ByteLevel"] and not steps[1].get("add_prefix_space")
    if kinds != ["NFC", "Replace", "Lowercase"] or split != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" or not bytewise or model.get("end_of_word_suffix") != "</w>":
        return None
    letters = _byte_letters()
    byte, vocabulary = {chr(c): bytes([b]) for b, c in letters.items()}, model["vocab"]

    def raw(token: str) -> bytes:
        word_end = token.endswith("</w>")
        return b"".join(byte[c] for c in (token[:-4] if word_end else token)) + _END * word_end

    order = [(bytes([b]), vocabulary.get(chr(letters[b]), -1)) for b in range(256)]
    order += [(bytes([b]) + _END, vocabulary.get(chr(letters[b]) + "</w>", -1)) for b in range(256)]
    for pair in model["merges"]:
        token = "".join(pair.split(" ") if isinstance(pair, str) else pair)
        order.append((raw(token), vocabulary[token]))
    ranks = {token: rank for rank, (token, _) in enumerate(order)}
    if len(ranks) != len(order):
        return None
    core = tiktoken.Encoding("parts", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe
    return core.encode_single_piece, np.array([i for _, i in order], np.int64), [token for token, _ in order[512:]]


class Encoder:
    """Ids of texts, by a tokenizer that drops spaces and line feeds and never joins across them.

    Texts are cut in words by Arrow; the distinct words of a chunk are tokenised and the ids of all words taken by their places, without Python
    work for a word's further occurrences. If ``merges_by_rank`` knows the tokenizer, words of ASCII and Latin letters are cut in parts, all by
    one call, and each distinct part is merged once a chunk. Nothing is kept from chunk to chunk.
    """

    def __init__(self, tokenizer_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.merged = Tokenizer.from_file(tokenizer_path), None
        if (found := merges_by_rank(tokenizer_path)) is not None:
            merged, ids, tokens = found
            if all(merged(t) == [512 + i] for i, t in enumerate(tokens)):
                self.merged, self.ids = merged, ids

    def _part_ids(self, parts: list[str]) -> tuple[pa.LargeListArray, np.ndarray, np.ndarray]:
        """Ids of the distinct parts, which of them each part is, and the number of ids of each distinct part; a line feed has none."""
        coded = pa.array(parts, pa.large_string()).dictionary_encode()
        found = [self.merged(x.encode() + _END) if x != "\n" else [] for x in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = self.ids[np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))].astype(np.uint32)
        return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]), pa.array(flat)), coded.indices, size

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words without spaces and line feeds back to back, and how many each has."""
        if self.merged is None:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        text = "\n".join([*words, ""])
        if _OTHER.search(text):
            whole = np.array([bool(_OTHER.search(w)) for w in words])
            parts_of, others = [w for w, o in zip(words, whole) if not o], [w for w, o in zip(words, whole) if o]
            own, own_size = self._word_ids(parts_of) if parts_of else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            found = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
            size = np.empty(len(words), np.int64)
            size[~whole], size[whole] = own_size, [len(x) for x in found]
            which = np.repeat(whole, size)
            ids = np.empty(len(which), np.uint32)
            ids[~which], ids[which] = own, np.fromiter(chain.from_iterable(found), np.uint32)
            return ids, size
        ids, which, size = self._part_ids(_PARTS.findall(text.lower()))
        each = size[which.to_numpy()]
        ends = np.cumsum(each)[np.flatnonzero(each == 0)]  # at the line feeds, the only parts without ids
        return ids.take(which).flatten().to_numpy(), np.diff(ends, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (large_string without nulls) back to back, and len+1 offsets of each text's."""
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = cut.flatten().dictionary_encode()
        pool, size = self._word_ids(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = words.indices.to_numpy()
        ids = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]), pa.array(pool))
        ends = np.concatenate([[0], np.cumsum(size[which])])
        at = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        return ids.take(words.indices).flatten().to_numpy().astype("<u4", copy=False), ends[at]


_encoders: dict[str, Encoder] = {}


def _workers_own(tokenizer_path: str) -> Encoder:
    """This worker's encoder, kept from task to task."""
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = Encoder(tokenizer_path)
    return _encoders[tokenizer_path]


def pieces(documents: DataFrame, tokenizer_path: str, end_id: int = 0, length: int = LENGTH, place: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids plus ``end_id``, cut only beyond ``length``.

    With ``place``, that column of the documents comes along as place. Null text is empty: one piece of the end id alone. A map stage without shuffle; only the digests leave it.
    """

    carried = place is not None

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["place"] * carried
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.int64()] * carried
        encoder, end = _workers_own(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts = batch["text"].cast(pa.large_string()).fill_null("")
            for lo, hi in chunks(text_bytes(texts)[1], CHUNK):
                out, some = [], batch.slice(lo, hi - lo)
                places = ([(x,) for x in some["place"].to_pylist()]) if carried else [()] * (hi - lo)
                ids, at = encoder.encode(texts.slice(lo, hi - lo))
                for doc, at_place, first, last in zip(some["doc_id"].to_pylist(), places, at[:-1].tolist(), at[1:].tolist()):
                    own, n = memoryview(ids[first:last]).cast("B"), last - first + 1
                    for p, begin in enumerate(range(0, n, length)):
                        part = own[4 * begin : 4 * (begin + length)]
                        crc = zlib.crc32(part)
                        out.append((doc, p, begin, min(length, n - begin), zlib.crc32(end, crc) if begin + length >= n else crc, *at_place))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    rows = documents.select(*own, *([F.col(place).cast("long").alias("place")] if carried else []))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", place long" * carried)


def match(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit in bulk over runs: (length, first rank, rows, first sequence, rows per sequence, offset).

    Documents sorted by falling length and open gaps sorted by size are both range-sorted, so equal neighbours are a run and the
    matching needs only the runs. A superstep takes the next run of documents, sweeps up to its successor,
    the smallest gap that holds it, gives the run's ranks to that gap's sequences in rank order, as many to each as fit, updates
    the gaps left and repeats with the ranks that found no place; a rank without a gap opens a sequence. That is what best fit
    in falling order does one by one. There are at most ``length`` runs of documents and ``length`` sizes of gaps, however many rows.
    """
    found, sequences = [], 0
    sizes: list[int] = []  # of open gaps, rising
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs of sequences (first, count)

    def opened(size: int, run: tuple[int, int]) -> None:
        if size > 0 and run[1] > 0:
            if size not in gaps:
                insort(sizes, size)
            gaps.setdefault(size, []).append(run)

    for own in sorted(counts, reverse=True):
        rank, left = 0, counts[own]
        while left:
            at = bisect_left(sizes, own)
            if at == len(sizes):
                size, first, count = length, sequences, -(-left // (length // own))
                sequences += count
            else:
                size = sizes[at]
                first, count = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size]
                    sizes.pop(at)
            each = size // own
            full, rest = min(count, left // each), 0
            if full:
                found.append((own, rank, full * each, first, each, length - size))
                opened(size - each * own, (first, full))
                rank, left = rank + full * each, left - full * each
            if full < count and left:
                rest = left
                found.append((own, rank, rest, first + full, rest, length - size))
                opened(size - rest * own, (first + full, 1))
                rank, left = rank + rest, 0
            opened(size, (first + full + (rest > 0), count - full - (rest > 0)))
    return found


def _spread(table: DataFrame) -> Column:
    """The places of ``table`` scaled to 64 bits, in their order as unsigned numbers."""
    most = table.agg(F.max("place")).first()[0] or 0
    return F.shiftleft("place", 64 - max(1, most.bit_length()))


def pack(table: DataFrame, length: int = LENGTH) -> DataFrame:
    """Adds sequence_id and offset to a repeatable table of pieces (doc_id, piece, length and more).

    Without a column place, pieces of a length are ranked by hash and sequences numbered as they are opened. With it (from 0, not null,
    about dense), pieces of a length are ranked by place and sequences numbered by the place of the piece that opens them, so that the
    order of the documents is that of the sequences; place does not come out.

    Ranks within a length are two-level (``common.ranked``), so a length may hold any share of the rows. What passes the
    driver is the histogram of lengths and the runs of placements, both bounded by the sequence length and checked.
    """
    spark = table.sparkSession
    counts = {r[0]: r[1] for r in table.groupBy("length").count().collect()}
    runs = match(counts, length)
    if len(runs) > 64 * length:
        raise ValueError(f"{len(runs)} runs of placements for sequences of {length}")
    placing = "place" in table.columns
    spread = _spread(table) if placing else F.xxhash64("doc_id", "piece")
    rows = ranked(table, ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], spread, "__rank").drop("__rank_n")
    places = [(own, rank, rank + n, first, each, base) for own, rank, n, first, each, base in runs]
    placed = spark.createDataFrame(places, "length long, low long, high long, first long, each long, base long")
    j = rows.join(F.broadcast(placed), (rows["length"] == placed["length"]) & (F.col("__rank") >= F.col("low")) & (F.col("__rank") < F.col("high")))
    nth = F.col("__rank") - F.col("low")
    packed = j.select(
        *[rows[c] for c in table.columns],
        F.expr("first + (__rank - low) div each").alias("sequence_id"),
        (F.col("base") + (nth % F.col("each")) * rows["length"]).alias("offset"),
    )
    if not placing:
        return packed
    packed = materialize(packed, "packed")
    openers = packed.filter("offset = 0").select("sequence_id", "place", "piece")
    numbers = ranked(openers, [], [F.col("piece")], _spread(openers), "__number").select("sequence_id", "__number")
    numbered = packed.join(numbers, "sequence_id").withColumn("sequence_id", F.col("__number"))
    return numbered.select(*[c for c in packed.columns if c != "place"])


def pack_documents(documents: DataFrame, tokenizer_path: str, end_id: int = 0, length: int = LENGTH, place: str | None = None) -> DataFrame:
    """Every document's pieces and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``place`` names the column whose order the sequences follow (see ``pack``). Null doc_ids and repeated rows are packed like any other; an empty table gives no rows.
    """
    return pack(materialize(pieces(documents, tokenizer_path, end_id, length, place), "pieces"), length)
