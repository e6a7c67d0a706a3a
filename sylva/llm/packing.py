"""Packing of tokenised documents into fixed windows by the sum-of-squares rule.

A document's full windows stand alone. Its rest is placed online: of all fill levels with an open window that it fits
(and of opening a new window), it goes where the sum of the squared numbers of windows per level becomes smallest. The
level array has one counter per fill level, so a placement costs one vector operation, and the open windows are kept
per level. At the end of a task's rows the open windows are evened out: as documents may be cut freely, the emptiest
windows' pieces fill the gaps of the fullest, and what is left of the last one is cut into windows of a power of two.
Each task packs the rows of its own split, so nothing is shuffled and a lost task is simply run again.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import sliced

WINDOW, END_ID = 4096, 2
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


#: Parts that are words of their own to the tokenizer: Latin letters, ASCII punctuation but apostrophes, single digits.
SIMPLE_PARTS = r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+|[0-9]"
#: Texts and chunks of such parts only, as one class of characters each, so that a match takes linear time.
PLAIN_TEXT = r"[A-Za-zÀ-ÖØ-öø-ÿ!-&(-~ \t\r\n]*"
SIMPLE_CHUNK = r"[A-Za-zÀ-ÖØ-öø-ÿ!-&(-~]+"


#: Texts on which a tokenizer file has to agree with its parts put together: letters, digits, marks, cases, white space.
PROBES = (
    "plain words, and more of them", "MiXeD Case ÀÉÎÕÜ straße ÿ", "a1b22c333 4.5e-6 7/8", "don't we'll THEY'RE I'd 'tis rock'n'roll",
    "tabs\tand\nlines\r\n  double  spaces ", "~!@#$%^&*()_+{}|:\"<>?[];,./-=\\`", "«guillemets» café—naïve ñandú ¿qué?", "日本語 русский ελληνικά",
    "x" * 60 + "9" * 20 + "-" * 20, "snake_case camelCase http://a.b/c?d=e&f#g", " ", "",
)


class WordCachedTokenizer:
    """Exact ids of a ``tokenizers`` file whose words never span a space or line feed, with bounded caches.

    A text of simple parts and white space is put together from its parts; new parts are encoded by the library in one
    text and told apart by their last tokens. Any other text is cut into chunks at spaces and line feeds: a new chunk of
    simple parts is put together likewise, another is encoded by the library alone. A cache beyond ``limit`` entries
    becomes the old generation, of which only what is seen again lives on. A special token's string could span a cut, or
    come about by lower-casing, so a text that holds one in any case goes to the library whole. Whether a tokenizer file
    cuts words as assumed here is tried on ``PROBES`` when it is loaded; if it does not, all texts go to it whole.
    """

    def __init__(self, path: str, limit: int = 220_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}
        self.is_plain = re.compile(PLAIN_TEXT).fullmatch
        self.special = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.is_simple = re.compile(SIMPLE_CHUNK).fullmatch
        self.cut = re.compile(SIMPLE_PARTS).findall
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.fast = True
        self.fast = all(self._agrees(text) for text in PROBES)

    def _agrees(self, text: str) -> bool:
        try:
            return self.encode(text) == self.whole(text).tobytes()
        except (KeyError, ValueError):
            return False

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def known(self, parts: list[str]) -> dict[str, bytes]:
        """A cache that holds all the simple parts given."""
        if len(self.parts) > self.limit:
            self.old_parts, self.parts = self.parts, {}
        known, old = self.parts, self.old_parts
        new = set(parts).difference(known)
        if new:
            known.update([(p, old[p]) for p in new if p in old])
            missing = [p for p in new if p not in known]
            if missing:
                ids = self.tokenizer.encode_batch_fast([" ".join(missing)], add_special_tokens=False)[0].ids
                ids = np.array(ids, dtype="<u4")
                stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                if len(stops) != len(missing):
                    raise ValueError("the tokenizer file does not mark the ends of words")
                raw, start = ids.tobytes(), 0
                for part, stop in zip(missing, stops, strict=True):
                    known[part] = raw[start:stop]
                    start = stop
        return known

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        lowered = text.lower()
        if not self.fast or any(s in lowered for s in self.special):
            return self.whole(text).tobytes()
        if self.is_plain(text):
            parts = self.cut(lowered)
            known = self.known(parts)
            return b"".join([known[p] for p in parts])
        try:
            text.encode("latin-1")
            text = lowered  # within Latin-1 as the library does; fewer chunks to keep
        except UnicodeEncodeError:
            pass
        chunks = text.replace("\n", " ").split(" ")
        if len(self.cache) > self.limit:
            self.old, self.cache = self.cache, {}
        cache, old = self.cache, self.old
        new = set(chunks).difference(cache)
        if new:
            simple: dict[str, list[str]] = {}
            for chunk in new:
                if (found := old.get(chunk)) is not None:
                    cache[chunk] = found
                elif self.is_simple(chunk):
                    simple[chunk] = self.cut(chunk.lower())
                else:
                    cache[chunk] = self.whole(chunk).tobytes()
            if simple:
                known = self.known([p for parts in simple.values() for p in parts])
                cache.update((chunk, b"".join([known[p] for p in parts])) for chunk, parts in simple.items())
        return b"".join([cache[c] for c in chunks])


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordCachedTokenizer:
    """One tokenizer for all tasks of a worker process, with what its cache holds."""
    return WordCachedTokenizer(path)


class SumOfSquares:
    """Open windows by fill level; pieces are (document, start, length)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list[tuple[int, int, int]]]] = {}

    def place(self, piece: tuple[int, int, int]) -> list[tuple[int, int, int]] | None:
        """Put a piece of 1..window tokens; the window's pieces if that fills it."""
        n, c, w = piece[2], self.count, self.window
        if n == w:
            return [piece]
        # Moving a window from level h to h + n changes the sum of squares by 2 (c[h+n] - c[h] + 1); full windows do
        # not count, so at h = w - n the change is 1 - 2 c[h]; a new window adds 2 c[n] + 1.
        change = np.where(c[1 : w - n] > 0, 2 * (c[n + 1 : w] - c[1 : w - n] + 1), np.iinfo(np.int64).max)
        best, least = 0, 2 * c[n] + 1
        if len(change) and change[k := int(change.argmin())] < least:
            best, least = k + 1, change[k]
        if c[w - n] and 1 - 2 * c[w - n] <= least:
            best = w - n
        if best:
            held = self.open[best].pop()
            c[best] -= 1
        else:
            held = []
        held.append(piece)
        if best + n == w:
            return held
        c[best + n] += 1
        self.open.setdefault(best + n, []).append(held)
        return None

    def finish(self) -> Iterator[list[tuple[int, int, int]]]:
        """The open windows, filled up with cut pieces of the emptiest; the last rest in powers of two."""
        held = [(level, x) for level in sorted(self.open, reverse=True) for x in self.open[level]]
        self.open, self.count[:] = {}, 0
        i, j, stock = 0, len(held), []
        while i < j:
            level, pieces = held[i]
            i += 1
            gap = self.window - level
            while gap and (stock or i < j):
                if not stock:
                    j -= 1
                    stock = held[j][1][::-1]
                doc, start, n = stock.pop()
                take = min(n, gap)
                pieces.append((doc, start, take))
                gap -= take
                if take < n:
                    stock.append((doc, start + take, n - take))
            if gap:
                stock = pieces[::-1]
                break
            yield pieces
        while stock:
            left = sum(p[2] for p in stock)
            size, out = 1 << (min(left, self.window).bit_length() - 1), []
            while size:
                doc, start, n = stock.pop()
                take = min(n, size)
                out.append((doc, start, take))
                size -= take
                if take < n:
                    stock.append((doc, start + take, n - take))
            yield out


def pack(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document, with its sequence and offset.

    Each document is its ids and ``end_id``; null and empty texts are ``end_id`` alone. A null doc_id stays null;
    repeated rows are packed each; an empty table gives an empty result. Sequences are gapless from offset 0 and hold
    ``window`` tokens, but for a few per task whose length is a smaller power of two. ``sequence_id`` holds the task's
    number in its high bits. Memory: one record batch, and the rests that stand in
    open windows, of which the rule leaves few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = word_tokenizer(tokenizer_path), SumOfSquares(window)
        sequence = TaskContext.get().partitionId() << 40
        end = np.array([end_id], dtype="<u4").tobytes()
        rest: dict[int, tuple] = {}  # of a document whose rest is still open: doc_id, tokens, start and ids of the rest
        done: list[tuple] = []
        doc = 0

        def close(pieces: list[tuple[int, int, int]]) -> None:
            nonlocal sequence
            offset = 0
            for d, start, n in pieces:
                doc_id, tokens, base, ids = rest[d]
                crc = zlib.crc32(ids[4 * (start - base) : 4 * (start - base + n)])
                done.append((doc_id, start, n, crc, tokens, sequence, offset))
                offset += n
            sequence += 1

        def drop(pieces: list[tuple[int, int, int]]) -> None:
            for d in {p[0] for p in pieces}:
                rest.pop(d, None)

        def emit() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [[]] * 7
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in sliced(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder.encode(text or "") + end
                tokens = len(ids) // 4
                full = tokens - tokens % window
                for start in range(0, full, window):
                    done.append((doc_id, start, window, zlib.crc32(ids[4 * start : 4 * (start + window)]), tokens, sequence, 0))
                    sequence += 1
                if full < tokens:
                    rest[doc] = (doc_id, tokens, full, ids[4 * full :])
                    if filled := packer.place((doc, full, tokens - full)):
                        close(filled)
                        drop(filled)
                doc += 1
            if len(done) > 20_000:
                yield emit()
        for pieces in packer.finish():
            close(pieces)
        yield emit()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
