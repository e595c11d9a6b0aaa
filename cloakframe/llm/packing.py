"""Hierarchical packing of documents into token windows of several lengths.

A document's tokens are cut into whole windows of the longest tier; what is left is routed to the shortest tier that
holds it. Each tier is packed, longest first; gaps in long windows are filled with the largest fitting pieces of
shorter tiers, and where none fits a piece is cut. So every window but the last few of a task is full; the rest of a
task leaves as windows whose sizes are powers of two. Windows are dealt to step groups in serpentine order of size,
which keeps the tokens of the groups of a flush level.

One narrow pass: no shuffle, no global state. A task's windows follow from its input split alone, so a lost executor
is replaced by running its tasks again. Memory is one Arrow batch plus FLUSH_TOKENS pending tokens.

Defined results
* null text counts as empty: its only token is the end-of-document id;
* rows that repeat a doc_id are packed one by one; ties need no rule, since order is the input's;
* texts of any length are cut into pieces; each token lies in exactly one piece;
* a special string of the vocabulary inside a text is encoded as the tokenizer does by default (``plain``: as text);
* other columns are never looked at.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, settled, text_blocks

TOKENIZER = "byte_bpe_50k.json"
TIERS = (256, 512, 1024, 2048)
EOS_ID = 1
STEP_WINDOWS = 8
FLUSH_TOKENS = 128 * 2048
#: Distinct words of at most LONGEST characters whose ids a task remembers; the memory is emptied when full.
REMEMBERED, LONGEST = 300_000, 64

#: Texts of these characters only are split into words here; any other text goes to the tokenizer whole.
_UNUSUAL = re.compile("[^\\t\\n\\r\\x20-\\x7eÀ-ÖØ-öø-ÿ]")
#: The split rule of the byte-level vocabulary, for those characters. The seven contractions.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+")


def _printable_bytes() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself, or one from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Unsafe(Exception):
    """A stretch between spaces that cannot be read on its own."""


class Memory(dict):
    """What a short key encodes to, computed when first met; emptied when full."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key: str) -> bytes:
        out = self.compute(key)
        if len(key) > LONGEST:
            return out
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = out
        return out


class Coder:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    A single space between two characters that are not white space always begins a new word of the vocabulary's
    split rule, so the stretches between such spaces are encoded one by one and remembered. A text with any other
    space is split with a plain regular expression; a text with unusual characters or with a special string of the
    vocabulary goes to the tokenizer whole. Words are merged by rank. With ``plain``, special strings are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain
        spec = json.load(open(path, encoding="utf-8"))
        special = {t["content"] for t in spec.get("added_tokens", ())}
        self.special = re.compile("|".join(map(re.escape, sorted(special)))) if special and not plain else None
        of = _printable_bytes()
        ranks = {bytes(of[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.word = Memory(lambda w: array("I", merge(w)).tobytes()).__getitem__
        self.stretch = Memory(self.after_space).__getitem__

    def forget(self) -> None:
        """Empty both memories."""
        for short in (self.word, self.stretch):
            short.__self__.clear()

    def by_tokenizer(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def split(self, text: str) -> bytes:
        if _UNUSUAL.search(text):
            return self.by_tokenizer(text)
        return b"".join(map(self.word, _WORDS.findall(text)))

    def after_space(self, stretch: str) -> bytes:
        if not stretch or stretch != stretch.strip():
            raise Unsafe
        return self.split(" " + stretch)

    def encode(self, text: str) -> bytes:
        if self.special and self.special.search(text):
            return self.by_tokenizer(text)
        first, *rest = text.split(" ")
        if rest and first == first.rstrip():
            try:
                return self.split(first) + b"".join(map(self.stretch, rest))
            except Unsafe:
                pass
        return self.split(text)


_coders: dict[tuple[str, bool], Coder] = {}


def coder(tokenizer: str, plain: bool = False) -> Coder:
    """The coder of a file, by path or by the name of an installed public vocabulary; one per Python worker."""
    if (tokenizer, plain) not in _coders:
        path = tokenizer
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        _coders[tokenizer, plain] = Coder(path, plain)
    return _coders[tokenizer, plain]


class Packer:
    """Pieces are [doc_id, start, length, ids of the document, tokens of the document]; a window is a list of them."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))
        self.pools: dict[int, deque] = {t: deque() for t in self.tiers}
        self.held = dict.fromkeys(self.tiers, 0)
        self.windows: list[list[list]] = []

    def add(self, doc_id, ids: bytes) -> None:
        n, top = len(ids) // 4, self.tiers[-1]
        for start in range(0, n - top + 1, top):
            self.windows.append([[doc_id, start, top, ids, n]])
        if n % top:
            self.hold([doc_id, n - n % top, n % top, ids, n])

    def hold(self, piece: list, front: bool = False) -> None:
        tier = next(t for t in self.tiers if piece[2] <= t)
        (self.pools[tier].appendleft if front else self.pools[tier].append)(piece)
        self.held[tier] += piece[2]

    def take(self, tier: int) -> list:
        piece = self.pools[tier].popleft()
        self.held[tier] -= piece[2]
        return piece

    def fill(self, window: list, room: int, tiers: list[int]) -> None:
        """Fill a window to the brim from these tiers, which hold enough: the largest piece that fits, else a cut."""
        while room:
            tier = next((t for t in tiers if self.pools[t] and self.pools[t][0][2] <= room), None)
            if tier is None:
                doc_id, start, length, ids, n = self.take(next(t for t in reversed(tiers) if self.pools[t]))
                window.append([doc_id, start, room, ids, n])
                self.hold([doc_id, start + room, length - room, ids, n], front=True)
                return
            window.append(piece := self.take(tier))
            room -= piece[2]

    def pack(self) -> None:
        """Longest tier first, as long as its pieces and what is shorter fill windows of its size."""
        for k in range(len(self.tiers) - 1, -1, -1):
            tier, below = self.tiers[k], list(self.tiers[: k + 1][::-1])
            while self.pools[tier] and sum(self.held[t] for t in below) >= tier:
                window = [self.take(tier)]
                self.fill(window, tier - window[0][2], below)
                self.windows.append(window)

    def finish(self) -> None:
        """The rest of a task: windows of decreasing powers of two."""
        self.pack()
        size, order = 1 << (self.tiers[-1].bit_length() - 1), list(self.tiers[::-1])
        while left := sum(self.held.values()):
            while size > left:
                size >>= 1
            self.windows.append(window := [])
            self.fill(window, size, order)


def _balanced(windows: list, width: int) -> Iterator[tuple[int, list]]:
    """(group, window): windows in order of size dealt back and forth over the groups."""
    groups = max(1, -(-len(windows) // width))
    for k, w in enumerate(sorted(windows, key=lambda w: -sum(p[2] for p in w))):
        turn, at = divmod(k, groups)
        yield (at if turn % 2 == 0 else groups - 1 - at), w


SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint, ids binary"


def pack(df: DataFrame, tokenizer: str = TOKENIZER, tiers: tuple[int, ...] = TIERS, eos_id: int = EOS_ID, step_windows: int = STEP_WINDOWS, id_col: str = "doc_id", text_col: str = "text", plain: bool = False) -> DataFrame:
    """One row per piece; ``ids`` are its little-endian unsigned 32-bit token ids, ``tier`` the size of its window.

    A special string inside a text gets its special id, as the tokenizer does by default; with ``plain`` it is text."""
    eos = array("I", [eos_id]).tobytes()
    types = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding, packer = coder(tokenizer, plain), Packer(tiers)
        base = TaskContext.get().partitionId() << 36
        windows_out, groups_out, pending = 0, 0, 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal windows_out, groups_out
            windows, packer.windows = packer.windows, []
            for a in range(0, len(windows), 256):
                part, cols = windows[a : a + 256], [[] for _ in types]
                for group, window in _balanced(part, step_windows):
                    offset, size = 0, sum(p[2] for p in window)
                    for doc_id, start, length, ids, n in window:
                        for c, v in zip(cols, (doc_id, start, length, n, base + windows_out, offset, size, base + groups_out + group, ids[4 * start : 4 * (start + length)]), strict=True):
                            c.append(v)
                        offset += length
                    windows_out += 1
                groups_out += -(-len(part) // step_windows)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1)
            for lo, hi, _, _ in text_blocks(texts):
                for doc_id, text in zip(ids_of.slice(lo, hi - lo).to_pylist(), texts.slice(lo, hi - lo).to_pylist(), strict=True):
                    ids = coding.encode(text or "") + eos
                    packer.add(doc_id, ids)
                    pending += len(ids) // 4
                if pending >= FLUSH_TOKENS:
                    packer.pack()
                    pending = 0
                    yield from emit()
        packer.finish()
        yield from emit()
        coding.forget()

    return df.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(settled(run), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
