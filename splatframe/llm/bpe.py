"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last bytes cuts each text into chunks, so that texts with a common passage have chunks in
common. A chunk is encoded once and its ids are kept in the worker, by content; the memory of a worker is bounded, and
what falls out is encoded anew, so results don't depend on it. Chunks end anywhere; ids beside a join may differ from
those of the whole text. Each join is repaired: a window around it is encoded again and grows until its first and last
words get the same ids as in the chunks beside it, and the chunks' ids beyond those words stay.

Why agreement there is enough: the splitting pattern has a boundary at some places whatever stands around (before a
space or line break that stands alone between two other characters, between ASCII letters and digits, between an
ideograph and a full stop); ids never reach across it. Windows begin and end at such places. Chunks without any are
passed over and encoded in one window with their neighbours, once, so a text without such places takes no longer than
its encoding as a whole.

Chunks of plain Latin text are encoded by tiktoken, over the same vocabulary file's ranks; others, and those with the
special token, by the tokenizers library, as the two may know different Unicode versions. Decoding joins the bytes of
the ids and reads them as UTF-8, as the byte-level decoder does.

Null texts are encoded as empty ones: no ids. Texts are taken whole, of any length and script. Repeated rows and ties
each get their result; an empty table gives no rows. Extra columns, of any name, are ignored. There is no shuffle; a lost executor's tasks run again on others.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splatframe.llm.common import slices, texts_of

#: A cut falls where the hash's low bits are zero: chunks of about this many bytes.
CHUNK_BYTES = 512
#: Chunks are no longer than this, so one of a very long text can be kept.
CHUNK_MOST = 4096
_HASHED = 16
#: Bytes of chunks and their ids that a worker keeps.
CACHE_BYTES = 24 << 20
_KEPT_COST = 256  # an entry's own bytes beside its content

#: Last and first bytes of characters that aren't white space. Lead bytes shared with white space beyond ASCII
#: (U+0085, U+00A0, U+1680, U+180E, U+2000 to U+206F, U+3000) are left out.
_BEFORE = (
    rb"(?:(?<=[\x21-\x7e])|(?<=[\xc3-\xdf][\x80-\xbf])|(?<=[\xe0\xe4-\xef][\x80-\xbf]{2})|(?<=\xe2[\x82-\xbf][\x80-\xbf])"
    rb"|(?<=\xe3[\x81-\xbf][\x80-\xbf])|(?<=[\xf0-\xf4][\x80-\xbf]{3}))"
)
_AFTER = rb"(?:[\x21-\x7e\xc3-\xdf\xe0\xe4-\xef\xf0-\xf4]|\xe2[\x82-\xbf]|\xe3[\x81-\xbf])"
#: Ideographs and kana, which are letters in all versions of Unicode, and the full stop and commas beside them.
_LETTER = rb"(?:(?<=\xe3[\x81-\x82][\x81-\x96])|(?<=\xe3\x83[\x80-\xba])|(?<=[\xe5-\xe8][\x80-\xbf]{2}))"
_MARK = rb"(?:\xe3\x80[\x81\x82]|\xef\xbc\x8c)"
#: Places that end a piece of the splitting pattern, whatever stands around: before white space that stands alone
#: between two other characters; between ASCII letters and digits; between an ideograph and a full stop or comma.
_CALM = re.compile(
    _BEFORE + rb"(?=[ \n]" + _AFTER + rb")|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|" + _LETTER + rb"(?=" + _MARK + rb")"
)
#: Some of them, found faster.
_PLAIN = re.compile(rb"[\x21-\x7e](?= [\x21-\x7e])")
#: Pieces of the pattern beyond this size take the library, whose time doesn't grow with their square.
_LONG_PIECE = 1 << 14
_LONG = re.compile(rb"[^ \n]{%d}|\s{%d}" % (_LONG_PIECE, _LONG_PIECE))
#: Up to U+024F the Unicode classes of letters and digits don't differ between versions.
_FOREIGN = re.compile("[^\x00-\u024f]")


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """One byte-level vocabulary, loaded from a tokenizers JSON file."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", ())}
        ranks = {}
        for token, rank in spec["model"]["vocab"].items():
            if token.encode() not in self.special:
                ranks[bytes(alphabet[c] for c in token)] = rank
        most = max([*ranks.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * (most + 1)
        for token, rank in [*ranks.items(), *self.special.items()]:
            self.bytes[rank] = token
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()

    def encode(self, text: bytes) -> list[int]:
        found = text.decode()
        long = len(text) > _LONG_PIECE and _LONG.search(text)
        if long or any(s in text for s in self.special) or not text.isascii() and _FOREIGN.search(found):
            return self.exact.encode(found, add_special_tokens=False).ids
        return self.fast.encode_ordinary(found)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks: where a hash of the last bytes has its low bits zero, at character starts."""
    data = np.frombuffer(text, dtype=np.uint8)
    n = len(data)
    if n <= CHUNK_BYTES:
        return [n] if n else []
    h, span, factor = data.astype(np.uint32), 1, 0x01000193
    while span < _HASHED:  # the hash of twice as many bytes from two neighbours
        h = h[:-span] * np.uint32(factor) + h[span:]
        span, factor = 2 * span, factor * factor & 0xFFFFFFFF
    h ^= h >> np.uint32(15)
    found = np.flatnonzero((h * np.uint32(0x85EBCA6B)) >> np.uint32(16) & np.uint32(CHUNK_BYTES - 1) == 0) + _HASHED
    found = found[found < n]
    out, last = [], 0
    for end in [*found[(data[found] & 0xC0) != 0x80].tolist(), n]:
        while end - last > CHUNK_MOST:
            last += CHUNK_MOST
            while last > 0 and data[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if end - last >= CHUNK_BYTES // 8 or end == n:
            out.append(end)
            last = end
    return out


class ChunkEncoder:
    """Encodes whole texts by chunks that are kept."""

    def __init__(self, codec: Codec, cache_bytes: int = CACHE_BYTES):
        self.codec, self.cache_bytes = codec, cache_bytes
        self.kept: dict[bytes, array] = {}
        self.held = self.encoded = self.reused = self.repaired = 0

    def chunk(self, part: bytes) -> list[int]:
        known = self.kept.get(part)
        if known is not None:
            self.reused += len(part)
            return known.tolist()
        self.encoded += len(part)
        ids = self.codec.encode(part)
        packed = array("I", ids)
        cost = len(part) + packed.itemsize * len(packed) + _KEPT_COST
        if self.held + cost > self.cache_bytes:
            self.kept.clear()
            self.held = 0
        self.kept[part] = packed
        self.held += cost
        return ids

    def encode(self, text: bytes) -> list[int]:
        ends = cuts(text)
        if len(ends) < 2:
            return self.chunk(text) if text else []
        parts, first = [], 0
        for end in ends:
            parts.append(text[first:end])
            first = end
        coded = [self.chunk(p) for p in parts]
        out, at, k = list(coded[0]), ends[0], 1  # out holds the ids of text[:at] but for what the next join mends
        while k < len(parts):
            # A chunk without two calm places can't end a window: the join reaches into the next one that has them.
            m = k
            while m < len(parts) - 1 and not self._calm(parts[m]):
                m += 1
            out = self._join(text, out, at, ends[m - 1], coded[m], ends[m])
            at, k = ends[m], m + 1
        return out

    @staticmethod
    def _calm(part: bytes) -> bool:
        first = _PLAIN.search(part)
        if first and _PLAIN.search(part, first.end() + 1):
            return True
        found = _CALM.finditer(part)
        return next(found, None) is not None and next(found, None) is not None

    def _join(self, text: bytes, left: list[int], at: int, first: int, right: list[int], end: int) -> list[int]:
        """Ids of text[:end], from those of text[:at] and of the chunk text[first:end]; what lies between is new."""
        size = self.codec.bytes
        reach = 32
        while True:
            low, high = max(0, at - reach), min(end, first + reach)
            starts = [m.start() + low for m in _CALM.finditer(text[low:at])]
            stops = [m.start() + first for m in _CALM.finditer(text[first:high])]
            # The outermost word on each side is the one that must agree.
            begin, agree = (starts[0], starts[1]) if len(starts) > 1 else (0, 0) if low == 0 else (None, None)
            until, resume = (stops[-1], stops[-2]) if len(stops) > 1 else (end, end) if high == end else (None, None)
            if begin is None or until is None:
                reach *= 2
                continue
            window = self.codec.encode(text[begin:until])
            self.repaired += until - begin
            keep, n = len(left), at
            while n > begin:
                keep -= 1
                n -= len(size[left[keep]])
            rest, m = 0, first
            while m < until:
                m += len(size[right[rest]])
                rest += 1
            if n == begin and m == until:
                head = _ids_of(window, agree - begin, size)
                tail = _ids_of(window[::-1], until - resume, size)
                if head == left[keep : keep + len(head)] and tail == right[:rest][::-1][: len(tail)]:
                    del left[keep:]
                    left += window
                    left += right[rest:]
                    return left
            if low == 0 and high == end:  # the whole of both sides has been encoded again
                return self.codec.encode(text[:end])
            reach *= 2


def _ids_of(ids: list[int], n: int, size: list[bytes]) -> list[int] | None:
    """The first ids, that make n bytes; None if no number of ids does."""
    out = 0
    while n > 0:
        n -= len(size[ids[out]])
        out += 1
    return ids[:out] if n == 0 else None


_CODECS: dict[str, ChunkEncoder] = {}


def encoder(path: str | None) -> ChunkEncoder:
    """This worker's encoder; path defaults to the installed public vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _CODECS:
        _CODECS[path] = ChunkEncoder(Codec(path))
    return _CODECS[path]


def encode(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, ids: bool = True
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text, and with ids the ids and the decoded text."""
    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())] if ids else []
    schema = T.StructType(
        [
            T.StructField(doc_id, docs.schema[doc_id].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
            *more,
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        for whole in batches:
            for batch in slices(whole):
                sizes, id_hashes, text_hashes, all_ids, decoded = [], [], [], [], []
                for raw in texts_of(batch):
                    found = coder.encode(raw)
                    again = coder.codec.decode(found)
                    sizes.append(len(found))
                    id_hashes.append(hashlib.sha256(np.array(found, dtype="<u4").tobytes()).hexdigest())
                    text_hashes.append(hashlib.sha256(again.encode()).hexdigest())
                    if ids:
                        all_ids.append(found)
                        decoded.append(again)
                arrays = [batch["id"], pa.array(sizes, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
                if ids:
                    arrays += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)
