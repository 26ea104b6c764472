"""Encoding and decoding with a word-level BPE vocabulary, each distinct word once.

1. ``split_blocks`` cuts texts into words.  A block is a bounded run of texts of
   one task; it has its own list of distinct words, and each text becomes the
   positions of its words in that list.  The list goes out in buckets by hash.
2. ``encode_words`` brings equal words together by bucket and encodes each
   distinct word once.
3. ``assemble`` brings the ids back to the texts by block and position, and looks
   their pieces up in the vocabulary, which each worker loads; there is no join.

So a word travels once per block and not once per occurrence, and a very common
word is one entry of each block's list: no key is hot.

Texts of Latin letters are normalised and split by an equivalent pattern of
Python, all others by the library's own normaliser and pattern.

A null or empty text has no ids and decodes to an empty text.  The strings of
special tokens inside a text give their ids, as in the library.  Equal rows give
equal results.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from songsift.llm.batches import TEXT, pieces, texts_of
from songsift.session import settle

#: Bytes of text in a block, and for which there is a bucket of words; so the tasks
#: keep their size however much text there is.
BLOCK, BUCKET = 16 << 20, 8 << 20
_LAST_LATIN = "ſ"


def _latin_pattern() -> re.Pattern:
    """The vocabulary's split pattern for texts up to U+017F, with its classes spelled out."""
    kinds: dict[str, list[str]] = {"L": [], "N": []}
    for c in map(chr, range(ord(_LAST_LATIN) + 1)):
        kinds.get(unicodedata.category(c)[0], []).append(re.escape(c))
    letters, numbers = "".join(kinds["L"]), "".join(kinds["N"])
    blank = "\\t-\\r \\x85\\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{blank}{letters}{numbers}]+")


class Words:
    """Cuts a text into the words that the vocabulary encodes one by one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.special = [t["content"] for t in config["added_tokens"]]
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.split = Split(Regex(config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]), "removed", True)
        self.latin = _latin_pattern()
        self.beyond = re.compile(f"[^\\x00-{_LAST_LATIN}]")

    def plain(self, text: str) -> list[str]:
        if text.isascii() or not self.beyond.search(text):
            return self.latin.findall(text.lower())
        return [w for w, _ in self.split.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def of(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.at_special.split(text)
        return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self.plain(p))]


class Encoder:
    """Ids and pieces of single words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        config["added_tokens"], config["normalizer"] = [], None
        config["pre_tokenizer"] = config["pre_tokenizer"]["pretokenizers"][1]
        self.model = Tokenizer.from_str(json.dumps(config))
        vocabulary = {**config["model"]["vocab"], **self.special}
        names = [""] * (max(vocabulary.values()) + 1)
        for piece, number in vocabulary.items():
            names[number] = piece
        self.pieces = pa.array(names)

    def ids(self, words: list[str]) -> list[list[int]]:
        found = [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
        return [[self.special[w]] if w in self.special else x for w, x in zip(words, found)]

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The pieces of the ids of words that have ``counts`` ids each."""
        flat = self.pieces.take(pa.array(ids)).to_pylist()
        ends = np.cumsum(np.append(0, counts)).tolist()
        return [" ".join(flat[a:b]) for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One for each worker process, as loading takes a while."""
    return Encoder(path)


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


def _pack(numbers: np.ndarray, level: int = 1) -> bytes:
    """Small integers, byte plane by byte plane."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), level)


#: Lists of words travel twice, so they are worth a higher level.
_DENSE = 9


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


#: Places below the first take one byte, places below the second two.
_ONE, _TWO = 224, 224 + 31 * 256


def pack_places(places: np.ndarray) -> bytes:
    """Places of words, the small ones in few bytes."""
    two, more = (places >= _ONE) & (places < _TWO), places >= _TWO
    first = np.where(two, _ONE + ((places - _ONE) >> 8), np.where(more, 255, places)).astype(np.uint8)
    second = ((places[two] - _ONE) & 255).astype(np.uint8)
    parts = [zstandard.compress(x.tobytes(), 1) for x in (first, second)] + [_pack(places[more])]
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def unpack_places(data: bytes) -> np.ndarray:
    parts, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        parts.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    first, second = (np.frombuffer(zstandard.decompress(x), np.uint8).astype(np.int32) for x in parts[:2])
    places, two = first.copy(), (first >= _ONE) & (first < 255)
    places[two] = _ONE + ((first[two] - _ONE) << 8) + second
    places[first == 255] = _unpack(parts[2])
    return places


def split_blocks(df: DataFrame, keep: list[str], text: str, path: str, buckets: int, block: int = BLOCK) -> DataFrame:
    """Three kinds of rows, each with its ``block``.

    ``text``: ``n`` words of a text, which is number ``at`` of its block, and
    the kept columns.  ``places``: in ``data`` the places of all words of the
    block, text after text.  ``list``: in ``words`` the words of bucket ``at``
    and in ``data`` their places in the block's list, common words first.
    """
    types = dict(df.dtypes)
    schema = pa.schema(
        [("kind", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("n", pa.int64())]
        + [("data", pa.binary()), ("words", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number, size, texts = words_of(path), TaskContext.get().partitionId() << 32, 0, 0
        places: defaultdict[str, int] = defaultdict()
        places.default_factory = places.__len__
        found: list[np.ndarray] = []

        def rows(columns: list, kept: list[pa.Array] | None = None) -> pa.RecordBatch:
            arrays = [pa.array(c, t) for c, t in zip(columns, schema.types)]
            kept = kept or [pa.nulls(len(arrays[0]), t) for t in kept_types]
            return pa.RecordBatch.from_arrays([*arrays, *kept], [*schema.names, *keep])

        def close() -> pa.RecordBatch:
            every = np.concatenate(found)
            common = np.argsort(-np.bincount(every, minlength=len(places)), kind="stable")
            rank = np.empty(len(places), np.int32)
            rank[common] = np.arange(len(places))
            by_bucket: dict[int, list[str]] = {}
            for word in sorted(places):
                by_bucket.setdefault(zlib.crc32(word.encode()) % buckets, []).append(word)
            out = [("places", number, None, len(every), pack_places(rank[every]), None)]
            for bucket, members in by_bucket.items():
                at = rank[[places[w] for w in members]]
                spelled = zstandard.compress("\n".join(members).encode(), _DENSE)
                out.append(("list", number, bucket, len(members), _pack(at, _DENSE), spelled))
            return rows(list(zip(*out)))

        kept_types: list[pa.DataType] = []
        for piece in pieces(batches):
            kept_types = [piece.column(c).type for c in keep]
            counts = []
            for text_bytes in texts_of(piece):
                of_text = words.of(text_bytes.decode("utf-8", "replace"))
                found.append(np.fromiter(map(places.__getitem__, of_text), np.int32, len(of_text)))
                counts.append(len(of_text))
                size += len(text_bytes)
            n = len(counts)
            at = range(texts, texts + n)
            texts += n
            yield rows([["text"] * n, [number] * n, at, counts, [None] * n, [None] * n], [piece.column(c) for c in keep])
            if size >= block:
                yield close()
                number, size, texts, found = number + 1, 0, 0, []
                places.clear()
        if found:
            yield close()

    kept = "".join(f", `{c}` {types[c]}" for c in keep)
    return df.select(*keep, F.col(text).cast("binary").alias(TEXT)).mapInArrow(
        run, f"kind string, block bigint, at bigint, n bigint, data binary, words binary{kept}"
    )


def encode_words(blocks: DataFrame, path: str, buckets: int) -> DataFrame:
    """For each list of words its places, and the number of ids of each word and the ids, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        known: dict[str, list[int]] = {}
        for batch in batches:
            out = []
            for words, data, block in zip(*(batch.column(c).to_pylist() for c in ("words", "data", "block"))):
                found = zstandard.decompress(words).decode().split("\n")
                new = [w for w in found if w not in known]
                known.update(zip(new, encoder.ids(new)))
                ids = [known[w] for w in found]
                flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32)
                out.append((block, data, _pack(np.array(list(map(len, ids))), _DENSE), _pack(flat, _DENSE)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*out)], ["block", "places", "counts", "ids"]
                )

    lists = blocks.filter("kind = 'list'").select("block", F.col("at").alias("bucket"), "data", "words")
    return lists.repartition(buckets, "bucket").mapInArrow(run, "block bigint, places binary, counts binary, ids binary")


def assemble(
    blocks: DataFrame, encoded: DataFrame, keep: list[str], path: str, out: dict[str, tuple], finish: Callable, groups: int
) -> DataFrame:
    """Each text's ids and decoded text through ``finish(ids, decoded)``, which gives the fields of ``out``.

    Ids come to a block's list by place, pieces to the ids by id, and both to the
    texts by position.  Texts go out a few at a time.  ``out`` has the Spark and
    the Arrow type of each field.
    """
    types = dict(blocks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder_of(path)
        texts, lists, every = [], [], np.zeros(0, np.int32)
        for batch in batches:
            is_text = pc.equal(batch.column("kind"), "text")
            texts.append(batch.filter(is_text))
            for row in batch.filter(pc.invert(is_text)).select(["kind", "data", "counts", "ids"]).to_pylist():
                if row["kind"] == "places":
                    every = unpack_places(row["data"])
                else:
                    lists.append((_unpack(row["data"]), _unpack(row["counts"]), _unpack(row["ids"])))
        size = sum(len(places) for places, *_ in lists)
        counts, start, decoded = np.zeros(size, np.int64), np.zeros(size, np.int64), np.empty(size, object)
        before = 0
        for places, each, ids in lists:
            counts[places], start[places] = each, before + np.cumsum(each) - each
            decoded[places] = vocabulary.decoded(ids, each)
            before += len(ids)
        ids = np.concatenate([x for *_, x in lists]) if lists else np.zeros(0, np.int64)
        number, words = (np.concatenate([t.column(c).to_numpy() for t in texts]) for c in ("at", "n"))
        order = np.argsort(number)
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(words[order]) - words[order]
        row = 0
        for batch in texts:
            for few in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                found = []
                for _ in range(few.num_rows):
                    at = every[begin[row] : begin[row] + words[row]]
                    row += 1
                    each = counts[at]
                    steps = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
                    found.append(finish(ids[np.repeat(start[at], each) + steps], " ".join(decoded[at])))
                fields = [pa.array(list(c), kind) for c, (_, kind) in zip(zip(*found), out.values())]
                yield pa.RecordBatch.from_arrays([*map(few.column, keep), *fields], [*keep, *out])

    own = blocks.filter("kind != 'list'").select(
        "kind", "block", "at", "n", "data", *[F.lit(None).cast("binary").alias(c) for c in ("counts", "ids")], *keep
    )
    lists = encoded.select(
        F.lit("list").alias("kind"),
        "block",
        *[F.lit(None).cast("bigint").alias(c) for c in ("at", "n")],
        F.col("places").alias("data"),
        "counts",
        "ids",
        *[F.lit(None).cast(types[c]).alias(c) for c in keep],
    )
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"{c} {kind}" for c, (kind, _) in out.items()])
    return own.union(lists).repartition(groups, "block").groupBy("block").applyInArrow(run, schema)


def _whole(ids: np.ndarray, decoded: str) -> tuple:
    return ids.astype(np.int32), decoded


def _digests(ids: np.ndarray, decoded: str) -> tuple:
    return (
        len(ids),
        hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
        hashlib.sha256(decoded.encode()).hexdigest(),
    )


_WHOLE = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}
_DIGESTS = {
    "n_tokens": ("bigint", pa.int64()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}


def encode_texts(
    df: DataFrame, keep: list[str], path: str, text: str = "text", digests: bool = False, block: int = BLOCK
) -> DataFrame:
    """``ids`` and ``decoded`` of each text, or with ``digests`` their number and SHA-256.

    ``path`` names the vocabulary file, which every executor must be able to open.
    The split texts are written to the shared folder, since the word lists and
    the positions must belong together.
    """
    names = {"kind", "block", "at", "n", "data", "words", "counts", TEXT, "ids", "decoded", *_DIGESTS}
    if clash := names & set(keep):
        raise ValueError(f"rename {sorted(clash)} before keeping them")
    size = df.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0
    buckets, groups = -(-size // BUCKET) or 1, 2 * -(-size // block) or 1
    blocks = settle(split_blocks(df, keep, text, path, buckets, block), "words")
    encoded = encode_words(blocks, path, buckets)
    out, finish = (_DIGESTS, _digests) if digests else (_WHOLE, _whole)
    return assemble(blocks, encoded, keep, path, out, finish, groups)
