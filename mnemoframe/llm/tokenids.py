"""Token ids as directly addressable codes.

Texts are put in doc_id order by range, encoded with a public tokenizer (its file is a parameter) and written as images:
ids are split into byte-wide levels; a bitmap for each level says which ids go on in the next one, and a rank directory
over the bitmap leads there, so any token is read without decoding those before it.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, stored

MAGIC = b"DAC1"
#: Ids an image holds, but for a document that alone has more; documents a range holds, and ranges at most.
IMAGE_IDS, RANGE_DOCS, RANGES = 1 << 18, 4000, 10_000
#: Words and pre-tokens whose ids a worker remembers (some 100 MB); of words, those of the generation before are kept as well.
WORDS, PARTS = 500_000, 400_000
RANK_BITS = 512


class Codes:
    """Image of a sequence of 32-bit ids: bytes(codes) and Codes(bytes) are inverse; codes[i] and codes[a:b] read at random."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not an image of token ids")
        levels = int.from_bytes(image[4:8], "little")
        self.image, at = image, 8
        self.chunks, self.bits, self.ranks = [], [], []
        for _ in range(levels):
            n = int.from_bytes(image[at : at + 8], "little")
            at += 8
            self.chunks.append(np.frombuffer(image, np.uint8, n, at))
            at += n
            self.bits.append(np.frombuffer(image, np.uint8, -(-n // 8), at))
            at += -(-n // 8)
            r = -(-n // RANK_BITS)
            self.ranks.append(np.frombuffer(image, "<u4", r, at))
            at += 4 * r

    @staticmethod
    def of(ids: np.ndarray) -> Codes:
        rest, out = np.asarray(ids, np.uint32), []
        while len(rest) or not out:
            more = rest > 0xFF
            ones = np.packbits(more, bitorder="little")
            padded = np.append(np.bitwise_count(ones), np.zeros(-len(ones) % (RANK_BITS // 8), np.uint8))
            per = padded.reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.uint32)
            out += [len(rest).to_bytes(8, "little"), (rest & 0xFF).astype(np.uint8).tobytes(), ones.tobytes(), (np.cumsum(per, dtype=np.uint32) - per).astype("<u4").tobytes()]
            rest = rest[more] >> 8
        return Codes(b"".join([MAGIC, (len(out) // 4).to_bytes(4, "little"), *out]))

    def __bytes__(self) -> bytes:
        return self.image

    def __len__(self) -> int:
        return len(self.chunks[0])

    def _rank(self, level: int, i: int) -> int:
        """Ones before bit i."""
        first = i // RANK_BITS
        part = self.bits[level][first * (RANK_BITS // 8) : i // 8 + 1]
        ones = int(np.bitwise_count(part).sum()) if len(part) else 0
        if i // 8 < len(self.bits[level]):
            ones -= int(np.bitwise_count(self.bits[level][i // 8] >> (i % 8)))
        return (int(self.ranks[level][first]) if first < len(self.ranks[level]) else int(np.bitwise_count(self.bits[level]).sum())) + (ones if first < len(self.ranks[level]) else 0)

    def __getitem__(self, i):
        if isinstance(i, slice):
            a, b, step = i.indices(len(self))
            return self._between(a, max(a, b))[::step]
        if not -len(self) <= i < len(self):
            raise IndexError(i)
        i %= len(self)
        value = 0
        for level, chunk in enumerate(self.chunks):
            value |= int(chunk[i]) << 8 * level
            if not self.bits[level][i // 8] >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def _between(self, a: int, b: int) -> np.ndarray:
        out, where = np.zeros(b - a, np.uint32), np.arange(b - a)
        for level, chunk in enumerate(self.chunks):
            if a >= b:
                break
            out[where] |= chunk[a:b].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(self.bits[level][a // 8 : -(-b // 8)], bitorder="little")[a % 8 :][: b - a].astype(bool)
            where = where[more]
            a, b = self._rank(level, a), self._rank(level, b)
        return out


# The normalizer and the pre-tokenizer of files whose words can be encoded one by one.
BY_WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
BY_WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
BY_WORD_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": BY_WORD_PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def little(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder(dict):
    """Word (bytes between ASCII white space) -> its ids as little-endian 32-bit bytes.

    Where the file's normalizer and pre-tokenizer are the ones above, the tokenizer lower-cases, drops white space and never joins what
    it separates, so a text's ids are its words' ids in order. With any other file, texts go through the library whole.
    """

    #: Letters of one code point in either case, then ASCII punctuation but for the apostrophe: at most two pre-tokens, whose
    #: ids the model gives directly. Any other word goes through the whole tokenizer.
    SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ɏ]*)([!-&(-/:-@\\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = spec.get("added_tokens") or []
        self.added = [t["content"].lower().encode() for t in added]
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or self.SIMPLE.fullmatch(t["content"]) or t["content"].split() != [t["content"]] for t in added)
        self.by_word = plain and spec["normalizer"] == BY_WORD_NORMALIZER and spec["pre_tokenizer"] == BY_WORD_PRE_TOKENIZER
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        shown = {b: level.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        # what UTF-8 bytes from 128 on look like to the model
        for c in [*range(0x80, 0x800), *range(0x800, 0x10000, 0x40), *range(0x10000, 0x110000, 0x1000)]:
            if not 0xD800 <= c < 0xE000:
                shown.update(zip(chr(c).encode(), level.pre_tokenize_str(chr(c))[0][0]))
        self.shown, self.parts, self.before = shown, {}, {}

    def part(self, text: str) -> bytes:
        """Ids of one lower-case pre-token; printable ASCII looks the same to the model."""
        if (got := self.parts.get(text)) is None:
            low = text
            if not low.isascii():
                low = low.encode().decode("latin-1").translate(self.shown)
            got = little([t.id for t in self.model.tokenize(low)]) if low else b""
            if len(self.parts) >= PARTS:
                self.parts.clear()
            self.parts[text] = got
        return got

    def __missing__(self, word: bytes) -> bytes:
        if (out := self.before.get(word)) is not None:
            self[word] = out
            return out
        text = word.decode("utf-8", "replace")
        if m := self.SIMPLE.fullmatch(text):
            out = self.part(m[1].lower()) + self.part(m[2])
        else:
            out = self.whole(text)
        if len(self) >= WORDS:
            self.before = dict(self)
            self.clear()
        self[word] = out
        return out

    def whole(self, text: str) -> bytes:
        return little(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def text(self, text: bytes | None) -> bytes:
        if not self.by_word:
            return self.whole((text or b"").decode("utf-8", "replace"))
        words = (text or b"").lower()
        if any(t in words for t in self.added):  # these are told apart by case
            words = text
        return b"".join(map(self.__getitem__, words.split()))


_ENCODERS: dict[str, Encoder] = {}


def write(docs: DataFrame, tokenizer: str, end: int = 1, image_ids: int = IMAGE_IDS) -> DataFrame:
    """Encode docs and write their images in ascending doc_id order (nulls first); the table of images, reread.

    Columns: part (ranges in order), begin (ids before the image in its part), ids, doc_ids and lengths (of its documents),
    image. Rows that share a doc_id are ordered by a hash of their text. Every document ends with the id ``end``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = Encoder(tokenizer)
        encoder, part, begin = _ENCODERS[tokenizer], TaskContext.get().partitionId(), 0
        ids, docs_in, lengths, held = [], [], [], 0
        last = np.array([end], "<u4").tobytes()

        def image() -> pa.RecordBatch:
            codes = bytes(Codes.of(np.frombuffer(b"".join(ids), "<u4")))
            cols = [pa.array([part], pa.int32()), pa.array([begin], pa.int64()), pa.array([held], pa.int64()), pa.array([docs_in], pa.list_(doc_type)), pa.array([lengths], pa.list_(pa.int64())), pa.array([codes], pa.binary())]
            return pa.record_batch(cols, names=["part", "begin", "ids", "doc_ids", "lengths", "image"])

        for b in batches:
            doc_type = b.schema.field("doc_id").type
            for d, t in zip(b["doc_id"].to_pylist(), b["text"]):
                got = encoder.text(t.as_py()) + last
                if ids and held + len(got) // 4 > image_ids:
                    yield image()
                    begin += held
                    ids, docs_in, lengths, held = [], [], [], 0
                ids.append(got)
                docs_in.append(d)
                lengths.append(len(got) // 4)
                held += len(got) // 4
        if ids:
            yield image()

    bound_batches(docs.sparkSession)
    ranges = max(1, min(RANGES, -(-docs.count() // RANGE_DOCS)))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("key"))
    rows = rows.repartitionByRange(ranges, "doc_id", "key").sortWithinPartitions("doc_id", "key")
    return stored(rows.mapInArrow(run, f"part int, begin long, ids long, doc_ids array<{kind}>, lengths array<long>, image binary"), "images")


def read(images: DataFrame) -> DataFrame:
    """Per document of the images: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    parts = images.groupBy("part").agg(F.sum("ids").alias("n")).orderBy("part")
    base, bases = 0, []
    for part, n in parts.collect():  # RANGES rows at most
        bases.append((part, base))
        base += n
    firsts = images.sparkSession.createDataFrame(bases or [(0, 0)], "part int, base long")
    kind = images.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids = Codes(b["image"][k].as_py())[:].astype("<u4")
                lengths = b["lengths"][k].values.to_numpy()
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends, lengths)]
                start = ends - lengths + b["begin"][k].as_py() + b["base"][k].as_py()
                yield pa.record_batch([b["doc_ids"][k].values, pa.array(start), pa.array(lengths), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return images.join(F.broadcast(firsts), "part").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def tokens(images: DataFrame, doc_id: int, first: int, last: int) -> list[int]:
    """Ids [first, last) of one document, read at random from its image."""
    row = images.filter(F.array_contains("doc_ids", doc_id)).select("doc_ids", "lengths", "image").first()
    k = row["doc_ids"].index(doc_id)
    at = sum(row["lengths"][:k])
    return Codes(bytes(row["image"]))[at + first : at + min(last, row["lengths"][k])].tolist()


def encode(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """Per row of docs, from the images written and read back: doc_id, start, n_tokens (the end id included), ids_crc32.

    Null and empty texts have the end id alone. Repeated rows are written again. An empty table gives no images and an empty result;
    other columns are ignored. ids_crc32 is the unsigned CRC-32 of the ids as little-endian 32-bit integers.
    """
    return read(write(docs, tokenizer, end))
