"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

Merging is greedy and local, so a sequence of pieces is the encoding of its text if and only if each piece encodes to
itself and each adjacent pair encodes to itself; hence every prefix of a text has exactly one last piece. The table is
filled from left to right: an automaton over the vocabulary gives all pieces ending at a position, and the one that is
compatible with the last piece of the prefix before it is the last piece here. The ids are then read backwards from the
end of the text. Compatibility of a pair is found once by merging the two pieces' characters, and remembered.

Where no vocabulary piece has a space mark after another character, texts fall apart at such marks without changing the
result; encodings of those parts are kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import sliced

SPACE = "▁"


class PieceTable:
    """Encoder and decoder of a SentencePiece BPE model with byte fallback and the identity normaliser."""

    def __init__(self, path: str, limit: int = 300_000):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if any(model.is_unused(i) for i in plain):
            raise ValueError("models with unused pieces are not supported")
        probe = "Ａé é  x "  # changes under any normaliser but the identity
        if model.decode(model.encode(probe)) != probe:
            raise ValueError("only the identity normaliser with a space in front is supported")
        self.ids = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: model.get_score(i) for i in plain}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.control = {i for i in range(size) if model.is_control(i)}
        self.unknown = {i for i in range(size) if model.is_unknown(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.surfaces = [self.surface(i) for i in range(size)]
        self.divisible = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        # A line feed in no piece merges with nothing, so texts fall apart there too.
        alone = "" if any("\n" in p for p in self.ids) else "\n"
        self.cut = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + f"|{alone}" * bool(alone)).findall
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            # Only pieces that encode to themselves can be the last piece of a prefix.
            if len(piece) == 1 or self.merged(list(piece)) == [piece]:
                self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        self.limit = limit
        self.compatible: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, tuple[str, int, bytes]] = {}
        self.old: dict[str, tuple[str, int, bytes]] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """The symbols after greedy merging: best score first, leftmost among equals."""
        score, symbols = self.score, list(symbols)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        heap = [
            (-score[x], i, x) for i in range(len(symbols) - 1) if (x := symbols[i] + symbols[i + 1]) in score
        ]
        heapq.heapify(heap)
        n = len(symbols)
        while heap:
            _, i, x = heapq.heappop(heap)
            j = after[i] if symbols[i] else n
            if j >= n or symbols[i] + symbols[j] != x:
                continue
            symbols[i], symbols[j] = x, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (y := symbols[a] + symbols[b]) in score:
                    heapq.heappush(heap, (-score[y], a, y))
        return [s for s in symbols if s]

    def fits(self, left: str, right: str) -> bool:
        """Whether the pair encodes to itself."""
        if len(self.compatible) > 3 * self.limit:
            self.compatible.clear()
        found = self.compatible[left, right] = self.merged([*left, *right]) == [left, right]
        return found

    def pieces(self, text: str) -> list[str]:
        """The encoding of a text that has its space marks already; a character outside the vocabulary is its own piece."""
        last: list[str] = []
        known, filled = self.compatible, 0
        for end, (piece, n) in self.automaton.iter(text):
            if end < filled:
                continue
            while filled < end:
                last.append(text[filled])
                filled += 1
            start = end - n
            if start >= 0:
                before = last[start]
                fits = known.get((before, piece))
                if fits is None:
                    fits = self.fits(before, piece)
                if not fits:
                    continue
            last.append(piece)
            filled = end + 1
        last.extend(text[filled:])
        out, end = [], len(text) - 1
        while end >= 0:
            piece = last[end]
            out.append(piece)
            end -= len(piece)
        out.reverse()
        return out

    def piece_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is None:
                out += [self.byte[b] for b in p.encode("utf-8")]
            else:
                out.append(i)
        return out

    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return self.cut(marked) if self.divisible else [marked]

    def _found(self, parts: list[str]) -> list[tuple[str, int, bytes]]:
        """Ids joined by commas, their number and their bytes, of each part."""
        if len(self.cache) > self.limit:
            self.old, self.cache = self.cache, {}
        cache, long, surface = self.cache, {}, self.surfaces
        for part in set(parts).difference(cache):
            found = self.old.get(part)
            if found is None:
                ids = self.piece_ids(self.pieces(part))
                found = (",".join(map(str, ids)), len(ids), b"".join([surface[i] for i in ids]))
            (cache if len(part) <= 64 else long)[part] = found
        if long:
            return [cache[p] if p in cache else long[p] for p in parts]
        return [cache[p] for p in parts]

    def encode(self, text: str) -> list[int]:
        return [int(i) for found in self._found(self.parts(text)) for i in found[0].split(",")]

    def surface(self, i: int) -> bytes:
        """What one id adds to a decoded text."""
        if i in self.control:
            return b""
        if i in self.unknown:
            return " ⁇ ".encode()
        b = self.byte_of.get(i)
        return bytes([b]) if b is not None else self.text[i].replace(SPACE, " ").encode("utf-8")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the space put in front goes, and in a run of byte pieces what makes no character is U+FFFD."""
        out: list[str] = []
        raw = bytearray()
        first = True
        for i in [*ids, None]:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                first = False
                continue
            if raw:
                out.append(_characters(bytes(raw)))
                raw.clear()
            if i is None or i in self.control:
                continue
            surface = self.surface(i).decode("utf-8")
            out.append(surface[1:] if first and i not in self.unknown and surface[:1] == " " else surface)
            first = False
        return "".join(out)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of the ids joined by commas and of the decoded text."""
        found = self._found(self.parts(text))
        ids = hashlib.sha256(",".join([f[0] for f in found]).encode()).hexdigest()
        back = hashlib.sha256(b"".join([f[2] for f in found])[1:]).hexdigest()  # whole characters, after the space in front
        return sum(f[1] for f in found), ids, back


@lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    """One table for all tasks of a worker process, with what its caches hold."""
    return PieceTable(path)


def _characters(raw: bytes) -> str:
    """A run of bytes as text, each byte outside a whole character as U+FFFD."""
    out, k = [], 0
    while k < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[k : k + n].decode("utf-8"))
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
            out.append("\ufffd")
        k += n
    return "".join(out)


def encode_documents(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text; a null text is empty, an empty text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_table(model_path)
        for batch in sliced(batches):
            ids = pa.array([encoder.encode(t or "") for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return _rows(documents).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of every row of ``encoded(doc_id, ids)``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = piece_table(model_path)
        for batch in batches:
            texts = [decoder.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest_documents(documents: DataFrame, model_path: str) -> DataFrame:
    """Per document the number of ids and SHA-256 digests of ids and decoded text.

    Null texts count as empty (no ids, digests of the empty string); null doc_ids stay null; repeated rows stay; an
    empty table gives an empty result. No row leaves its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model_path)
        for batch in batches:
            found = [table.digest(t or "") for part in sliced([batch]) for t in part.column("text").to_pylist()]
            n, ids, back = (list(x) for x in zip(*found)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _rows(documents).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
