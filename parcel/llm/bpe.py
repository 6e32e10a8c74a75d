"""BPE encoding and decoding by content-defined chunk reuse.

A rolling hash over the UTF-8 bytes cuts each text into chunks; equal passages give equal
chunks wherever they stand. A chunk is encoded once per Python worker and its token bytes are
reused in every later document. A cut may fall inside a word, so the two pieces that meet at a
join are provisional: they are encoded again together, and the window grows over further
chunks until both of its ends lie at white space, where the tokenizer never merges. There the
tokens agree with those of the whole text.

Nothing is shuffled: token arrays are larger than the text, so carrying chunks through an
exchange would cost more than encoding them. Memory is bounded by the two caches.

Null text counts as empty: no tokens, digest of the empty string. Repeated rows are answered
one by one. Text of any length is read whole.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parcel.llm.common import documents, worker_cache

WINDOW = 32            # bytes under the rolling hash
CHUNK_BITS = 9         # a cut every 512 bytes on average
MAX_WORDS = 1_000_000    # word cache entries of a worker; emptied when full
MAX_CHUNK_BYTES = 48 << 20   # chunk cache bytes of a worker; emptied when full
BATCH_CHARS = 4 << 20

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_SPACE = re.compile("[ \n]")


def cut_points(data: np.ndarray, bits: int = CHUNK_BITS) -> np.ndarray:
    """Ends of chunks (ascending, the last is len(data)): where the hash of the WINDOW bytes
    before a position has ``bits`` zero bits on top, moved on to a character start."""
    n = len(data)
    if n <= WINDOW:
        return np.array([n]) if n else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        powers = _powers(n + 1)
        mixed = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        sums = np.cumsum(mixed * powers[1][:n], dtype=np.uint64)
        window = sums[WINDOW - 1:].copy()
        window[1:] -= sums[:-WINDOW]
        window *= powers[0][WINDOW - 1:n]
    at = np.flatnonzero((window >> np.uint64(64 - bits)) == 0) + WINDOW
    while len(at) and (inside := (at < n) & ((data[np.minimum(at, n - 1)] & 0xC0) == 0x80)).any():
        at = at + inside
    at = np.unique(at[at < n])
    return np.append(at, n)


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 17)
        for k, base in enumerate((_MULT, _INV)):
            step = np.full(n, np.uint64(base))
            step[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[k] = np.multiply.accumulate(step)
    return _POWERS


def byte_strings() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1
    characters for themselves, the rest by U+0100 onwards in byte order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class PlainWords:
    """Merges for words of Latin script without white space, by the same vocabulary. Byte 255
    never occurs in UTF-8 and stands for the word end, so its merges come first as they do in
    the vocabulary's numbering. Other words (None) are left to the tokenizer itself."""

    def __init__(self, tok):
        import json

        import tiktoken
        spec = json.loads(tok.to_str())
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.usable = (kinds == ["NFC", "Replace", "Lowercase"]
                       and spec["model"].get("end_of_word_suffix") == "</w>")
        if not self.usable:
            return
        table = byte_strings()
        added = {a["content"] for a in spec["added_tokens"]}
        ranks = {}
        for t, i in spec["model"]["vocab"].items():
            if t not in added:
                end = t.endswith("</w>")
                ranks[bytes(table[c] for c in t.removesuffix("</w>")) + b"\xff" * end] = i
        latin = [chr(c) for c in range(0x21, 0x250)]
        letters = "".join(c for c in latin if category(c)[0] == "L")
        numbers = "".join(c for c in latin if category(c)[0] == "N")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        split = split.replace(r"\s\p{L}\p{N}", r"\s" + letters + numbers)
        self.find = re.compile(split.replace(r"\p{L}", letters).replace(r"\p{N}", numbers)).findall
        # white space of any kind, controls, other scripts, possible special tokens
        self.hard = re.compile("[\x00-\x20\x7f-\xa0\u0250-\U0010ffff]|<\\|").search
        self.piece = tiktoken.Encoding("words", pat_str=r".", mergeable_ranks=ranks,
                                       special_tokens={})._core_bpe.encode_single_piece
        self.added = tuple(added)

    def encode(self, word: str) -> list[int] | None:
        if not self.usable or self.hard(word):
            return None
        ids: list[int] = []
        for piece in self.find(word.lower()):
            ids += self.piece(piece.encode() + b"\xff")
        return ids


class ChunkEncoder:
    """Encodes whole texts; keeps the words and chunks it has met. Words are numbered; their
    ids and strings lie end to end, so a run of words is gathered in one step."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.strings = {i: t.encode("utf-8") + b" "
                        for t, i in self.tok.get_vocab(with_added_tokens=True).items()}
        self.plain = PlainWords(self.tok)
        self.encoded_chunks = self.reused_chunks = 0
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.ids, self.id_ends = array("I"), array("q", [0, 0])
        self.said, self.said_ends = bytearray(), array("q", [0, 0])
        self.chunks: dict[bytes, tuple] = {}
        self.chunk_bytes = 0

    def word(self, word: str) -> int:
        """The number of a word; a new one is encoded."""
        k = self.index.get(word)
        if k is None:
            ids = self.plain.encode(word)
            if ids is None:
                ids = self.tok.encode(word, add_special_tokens=False).ids
            self.ids.extend(ids)
            self.id_ends.append(len(self.ids))
            for i in ids:
                self.said += self.strings[i]
            self.said_ends.append(len(self.said))
            k = self.index[word] = len(self.index)
        return k

    def chunk(self, raw: bytes) -> tuple:
        """(first piece, numbers of the words between, last piece); with no white space
        inside, the whole chunk is the first piece and the last is None."""
        got = self.chunks.get(raw)
        if got is not None:
            self.reused_chunks += 1
            return got
        self.encoded_chunks += 1
        words = _SPACE.split(raw.decode("utf-8", "surrogatepass"))
        if len(words) == 1:
            got = (words[0], (), None)
        else:
            inner = words[1:-1]
            try:
                got = (words[0], [self.index[w] for w in inner], words[-1])
            except KeyError:
                got = (words[0], [self.word(w) for w in inner], words[-1])
        self.chunk_bytes += 8 * len(raw)
        if self.chunk_bytes > MAX_CHUNK_BYTES:
            self.chunks, self.chunk_bytes = {}, 0
        self.chunks[raw] = got
        return got

    def words_of(self, text: str, out: list) -> None:
        """Append the word numbers of a text, chunk by chunk."""
        raw = text.encode("utf-8", "surrogatepass")
        joint = ""
        for a, b in _spans(cut_points(np.frombuffer(raw, np.uint8))):
            first, body, last = self.chunk(raw[a:b])
            joint += first          # the piece left open by the chunks before goes on here
            if last is None:
                continue
            out.append(self.word(joint))    # white space on both sides: it agrees now
            out.extend(body)
            joint = last
        out.append(self.word(joint))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Per text: ids as little-endian unsigned 32-bit integers, decoded text in UTF-8."""
        if len(self.index) > MAX_WORDS:
            self.forget()
        words: list[int] = []
        ends = []
        for t in texts:
            self.words_of(t, words)
            ends.append(len(words))
        words, ends = np.array(words, np.int64), np.array(ends, np.int64)
        ids, id_ends = _gather(np.array(self.ids, "<u4"), np.array(self.id_ends), words, ends)
        said, said_ends = _gather(np.frombuffer(bytes(self.said), np.uint8),
                                  np.array(self.said_ends), words, ends)
        ids, said = ids.tobytes(), said.tobytes()
        return [(ids[4 * a:4 * b], said[c:max(c, d - 1)])
                for (a, b), (c, d) in zip(_spans(id_ends), _spans(said_ends))]


def _gather(flat: np.ndarray, flat_ends: np.ndarray, words: np.ndarray, ends: np.ndarray):
    """Entries of the words one after another, and where each text's entries end."""
    starts = flat_ends[words]
    sizes = flat_ends[words + 1] - starts
    stops = np.cumsum(sizes)
    at = np.arange(stops[-1] if len(stops) else 0)
    at += np.repeat(starts - stops + sizes, sizes)
    return flat[at], stops[ends - 1] if len(stops) else stops


def _spans(ends: np.ndarray) -> list[tuple[int, int]]:
    return list(zip([0, *ends[:-1].tolist()], ends.tolist()))


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file; it outlives a task."""
    return worker_cache(("bpe", path), lambda: ChunkEncoder(path))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(doc_ids, texts) in runs of about BATCH_CHARS characters."""
    for part in text_slices(batches):
        yield part.column(0).to_pylist(), part.column(1).to_pylist()


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches (text in the second column) in parts of about BATCH_CHARS characters."""
    for batch in batches:
        ids, texts = range(batch.num_rows), batch.column(1)
        sizes = np.cumsum([len(t) for t in texts.to_pylist()]) if len(ids) else []
        start = 0
        while start < len(ids):
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + BATCH_CHARS)))
            yield batch.slice(start, end - start)
            start = end


def encode_documents(docs: DataFrame, path: str, outputs: str = "digest") -> DataFrame:
    """One row per document. ``outputs``: "digest" gives doc_id, n_tokens, ids_sha256 and
    decoded_sha256; "tokens" gives doc_id, n_tokens, ids (array<int>) and decoded."""
    if outputs not in ("digest", "tokens"):
        raise ValueError(f"outputs must be 'digest' or 'tokens', not {outputs!r}")
    digest = outputs == "digest"
    schema = "doc_id long, n_tokens long, " + (
        "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")

    def run(batches):
        enc = encoder(path)
        for ids, texts in slices(batches):
            rows = enc.encode(texts)
            out = {"doc_id": pa.array(ids, pa.int64()),
                   "n_tokens": pa.array([len(r[0]) // 4 for r in rows], pa.int64())}
            if digest:
                out["ids_sha256"] = pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows])
                out["decoded_sha256"] = pa.array(
                    [hashlib.sha256(r[1]).hexdigest() for r in rows])
            else:
                out["ids"] = pa.array([np.frombuffer(r[0], "<u4").astype(np.int32) for r in rows],
                                      pa.list_(pa.int32()))
                out["decoded"] = pa.array([r[1].decode("utf-8") for r in rows], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return documents(docs).mapInArrow(run, schema)
