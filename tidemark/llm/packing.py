"""Best-fit packing of tokenised documents: hierarchical residual packing.

Documents become token pieces of at most `capacity` tokens. Pieces are dealt to
groups of bounded size and packed best-fit decreasing within each group. Bins
that are nearly full are final. Underfull bins become items themselves, whole
and with their fill as length, and go into the next round in fewer groups, so
that a tree of rounds merges what single groups could not fill. A bin is final, too, if
it has no room for the smallest of the others. The rounds end when one group was
enough or a round merges nothing.

Only (item, length) pairs are shuffled; token ids never leave the tokenising task.

Edge cases: null and empty texts are one piece that holds only the end id;
longer documents are cut every `capacity` tokens; repeated rows are packed each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import stored
from tidemark.llm.textbytes import lean

CAPACITY = 4096
END_ID = 1
#: Bins filled to this share are final in the round that made them.
NEARLY_FULL = 0.97
#: Items of one group of a round, about.
GROUP_ITEMS = 4096
#: Words that a task keeps with their ids before it starts anew.
MAX_CACHED_WORDS = 1_000_000

# The steps of a word tokenizer whose words can be encoded one by one.
STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    None,
    {
        "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>",
        "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
    },
)

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte that byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Places(dict):
    """Words and their places; a word that is not there yet is added by `add`."""

    def __init__(self, add: Callable[[str], int]):
        super().__init__()
        self.add = add

    def __missing__(self, word: str) -> int:
        self[word] = at = self.add(word)
        return at


class WordTokenizer:
    """Exact ids of a lower-casing word-end BPE, each distinct word encoded once.

    White space never reaches such a vocabulary, so the ids of a text are those of
    its space-separated words in order; a tokenizer with other steps than STEPS
    encodes each text as a whole. Words of ASCII and Latin-1 letters go to
    the BPE model directly after the tokenizer's own steps (lower case, split
    into letter runs, digits and the rest, byte-level letters); any other word
    takes the library's whole path.
    """

    _simple = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    _part = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        steps = json.loads(self.whole.to_str())
        model = {k: v for k, v in steps["model"].items() if k not in ("vocab", "merges")}
        self.by_word = (steps["normalizer"], steps["pre_tokenizer"], steps["post_processor"], model) == STEPS
        self.model = self.whole.model
        chars = _byte_chars()
        self.letters = {c: "".join(chars[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.specials = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        self.at = _Places(self._new)
        self.at[""] = 0
        self.parts: dict[str, list[int]] = {}
        self.flat, self.starts, self.lengths = array("I"), array("q", [0]), array("q", [0])

    def _part_ids(self, part: str) -> list[int]:
        ids = self.parts.get(part)
        if ids is None:
            text = part if part.isascii() else part.translate(self.letters)
            ids = self.parts[part] = [t.id for t in self.model.tokenize(text)]
        return ids

    def _ids(self, word: str) -> list[int]:
        if word.isascii():  # the two most common shapes: letters, and letters with one mark behind
            if word.isalpha():
                return self._part_ids(word.lower())
            if word[:-1].isalpha() and word[-1] in ".,":
                return self._part_ids(word[:-1].lower()) + self._part_ids(word[-1])
        if not self._simple.fullmatch(word):
            return self.whole.encode(word, add_special_tokens=False).ids
        out: list[int] = []
        for part in self._part.findall(word.lower()):
            out += self._part_ids(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and where each text's begin (n + 1)."""
        if len(self.at) > MAX_CACHED_WORDS or len(self.flat) > 20 * MAX_CACHED_WORDS:
            self._reset()
        at = self.at
        where, counts = [], []
        for text in texts:
            if not self.by_word or any(s in text for s in self.specials):  # such a string can span no words but is one id
                ids = self.whole.encode(text, add_special_tokens=False).ids
                self._add(ids)
                where.append(np.array([len(self.starts) - 1]))
                counts.append(1)
                continue
            split = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            where.append(np.fromiter(map(at.__getitem__, split), np.int64, len(split)))
            counts.append(len(split))
        words = np.concatenate(where) if where else np.zeros(0, np.int64)
        lengths = np.frombuffer(self.lengths, np.int64)[words]
        begin = np.frombuffer(self.starts, np.int64)[words]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = np.frombuffer(self.flat, np.uint32) if self.flat else np.zeros(0, np.uint32)
        ids = flat[np.repeat(begin - ends + lengths, lengths) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]

    def _new(self, word: str) -> int:
        self._add(self._ids(word))
        return len(self.starts) - 1

    def _add(self, ids: list[int]) -> None:
        self.starts.append(len(self.flat))
        self.lengths.append(len(ids))
        self.flat.extend(ids)


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, so that its words stay known from task to task."""
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the CRC-32 of its ids.

    `tokenizer` is the file's name within the installed public vocabularies, or a path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import public_tokenizers

        encoder = _tokenizer(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer))
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            doc_ids = batch.column("doc_id").to_pylist()
            for lo in range(0, len(texts), 512):
                ids, at = encoder.encode(texts[lo : lo + 512])
                rows: list[tuple] = []
                for k in range(len(at) - 1):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        rows.append((doc_ids[lo + k], piece, start, len(part), zlib.crc32(part.tobytes())))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), _PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first, each into the fullest bin that still takes it."""
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, n = 0, 0  # bit r of open_rooms: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = open_rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        by_room[room - need].append(b)
        open_rooms |= 1 << (room - need)
    return bins, offsets


def _packer(capacity: int) -> Callable:
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "item"], ascending=[False, True], ignore_index=True)
        item, length = group["item"].to_numpy(), group["length"].to_numpy()
        bins, offsets = best_fit(length, capacity)
        name = np.full(len(item), np.iinfo(np.int64).max)
        np.minimum.at(name, bins, item)  # a bin is called after its smallest item
        fill = np.bincount(bins, length, len(item)).astype(np.int64)
        return pd.DataFrame({"item": item, "bin": name[bins], "place": offsets, "fill": fill[bins]})

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, nearly_full: float = NEARLY_FULL, group_items: int = GROUP_ITEMS) -> DataFrame:
    """items (item long unique, length long) -> (item, sequence_id, offset)."""
    closed_at = int(np.ceil(capacity * nearly_full))
    todo, rounds = items, []
    n = todo.count()
    while n:
        groups = -(-n // group_items)
        dealt = todo.withColumn("g", F.pmod(F.xxhash64("item", F.lit(len(rounds))), F.lit(groups)))
        packed = stored(dealt.groupBy("g").applyInPandas(_packer(capacity), "item long, bin long, place long, fill long"), "bins")
        rounds.append(packed)
        open_bins = packed.where((F.col("item") == F.col("bin")) & (F.col("fill") < closed_at)).select("item", F.col("fill").alias("length"))
        smallest, left = open_bins.agg(F.min("length"), F.count(F.lit(1))).first()
        if groups == 1 or left == n or not left:
            break
        todo = open_bins.where(F.col("length") + smallest <= capacity)
        n = todo.count()
    out = items.select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for packed in rounds:
        step = packed.select(F.col("item").alias("sequence_id"), "bin", "place")
        out = out.join(step, "sequence_id", "left").select(
            "item", F.coalesce("bin", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("place", F.lit(0))).alias("offset")
        )
    return out


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with the sequence and offset of each."""
    pieces = stored(token_pieces(docs, tokenizer, capacity, end_id).withColumn("item", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces.select("item", "length"), capacity), "item").drop("item")
