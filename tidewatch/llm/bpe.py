"""Byte-pair encoding by a merge automaton, and decoding by its arc labels.

The automaton starts as one state with a loop for each base symbol. Every merge (u, v), in order,
adds one gadget: a copy of the state behind u that lacks the arc v becomes the new target of all
u arcs, and an arc u+v that leads where v led is added wherever u could be read. All arcs of one
label share a target, so a state is named by the label read last and its missing arcs are the rules
of that label and of its right parts that were added before (``spine``). A sequence of labels is
what merging yields exactly if the automaton reads it. A word is encoded by reading labels
from left to right, longest first, along arcs the automaton has. Each place of a word is reached by
one path only, so a place that leads nowhere is given up once and for all.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from tidewatch.llm.common import map_text, worker_cache

_SHIFT = 20  # labels are below 2**20
_NEVER = 1 << 40
_CACHE = 200_000  # words of a generation that a worker remembers

# The pre-split of the vocabulary file. White space is spelled out, as the file's
# pattern takes the Unicode property and Python's also takes U+001C to U+001F.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
# Texts with other characters go through the library's own normalizer and pre-split, so that
# neither the version of Unicode nor rules of lower-casing can differ.
_BEYOND = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")


def byte_chars() -> dict[str, int]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class MergeAutomaton:
    """Deterministic automaton over labels (token ids) compiled from an ordered merge list."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        self.suffix = suffix
        self.first = {}  # rule (u, v) -> its rank
        self.rank = {}  # label -> rank of the gadget that added it
        self.left = {}
        self.spine = {}  # label -> ((label or right part, rules of it that count: rank below), ...)
        made = {}
        for rank, (a, b) in enumerate(merges):
            u, v, uv = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.first[u << _SHIFT | v] = rank
            if uv in made:
                continue
            made[uv] = (u, v)
            self.rank[uv], self.left[uv] = rank, u
            self.spine[uv] = ((uv, _NEVER), (v, rank), *(
                (t, min(limit, rank)) for t, limit in self.spine.get(v, ())[1:]
            ))
        base = [t for t in vocabulary.values() if t not in made]
        for t in base:
            self.spine[t] = ((t, _NEVER),)
        self.symbols = {s: vocabulary[s] for s in vocabulary if vocabulary[s] in set(base)}
        spelled = {t: (t,) for t in base}
        for uv, (u, v) in made.items():  # in order of rank, so the parts are spelled already
            spelled[uv] = spelled[u] + spelled[v]
        # trie of the labels over base symbols; an entry is [label or -1, following node or None]
        self.root: dict = {}
        self.length = [0] * (max(spelled) + 1)
        for label, path in spelled.items():
            self.length[label] = len(path)
            node = self.root
            for symbol in path[:-1]:
                entry = node.get(symbol)
                if entry is None:
                    entry = node[symbol] = [-1, {}]
                elif entry[1] is None:
                    entry[1] = {}
                node = entry[1]
            node.setdefault(path[-1], [-1, None])[0] = label
        # the longest label that is a proper prefix of a label, or -1
        self.shorter = [-1] * len(self.length)
        for label, path in spelled.items():
            node = self.root
            for symbol in path[:-1]:
                entry = node[symbol]
                if entry[0] >= 0:
                    self.shorter[label] = entry[0]
                node = entry[1]
        self.known: dict[int, bool] = {}

    def has_arc(self, state: int, label: int, below: int = _NEVER) -> bool:
        """Whether the state behind ``state`` has the arc, after the rules ranked under ``below``."""
        while True:
            for part, limit in self.spine[state]:
                if self.first.get(part << _SHIFT | label, _NEVER) < min(limit, below):
                    return False
            rank = self.rank.get(label)
            if rank is None:
                return True
            # the arc came with its gadget, wherever its left part could be read then
            label, below = self.left[label], min(below, rank + 1)

    def _longest(self, symbols: list[int], place: int, n: int) -> int:
        node, found = self.root, -1
        while place < n and node:
            entry = node.get(symbols[place])
            if entry is None:
                break
            if entry[0] >= 0:
                found = entry[0]
            node = entry[1]
            place += 1
        return found

    def encode(self, symbols: list[int]) -> list[int]:
        """Labels on the only path through the word; each place is given up at most once."""
        n, known, length, shorter = len(symbols), self.known, self.length, self.shorter
        path: list[int] = []
        given_up = None
        place, label = 0, self._longest(symbols, 0, n)
        while place < n:
            while label >= 0:
                if given_up is None or not given_up[place + length[label]]:
                    if not path:
                        break
                    arc = path[-1] << _SHIFT | label
                    allowed = known.get(arc)
                    if allowed is None:
                        if len(known) > 500_000:
                            known.clear()
                        allowed = known[arc] = self.has_arc(path[-1], label)
                    if allowed:
                        break
                label = shorter[label]
            if label >= 0:
                path.append(label)
                place += length[label]
                label = self._longest(symbols, place, n)
            else:
                if given_up is None:
                    given_up = bytearray(n + 1)
                given_up[place] = 1
                label = path.pop()
                place -= length[label]
                label = shorter[label]
        return path


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, suffix)
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre = library.normalizer, library.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        names = {v: k for k, v in model["vocab"].items()} | {v: k for k, v in self.special.items()}
        self.labels = [names.get(i, "") for i in range(max(names) + 1)]
        self.joint = "" if spec["decoder"] else " "
        symbols = self.automaton.symbols
        inner, final = [0] * 256, [0] * 256
        for char, byte in byte_chars().items():
            inner[byte], final[byte] = symbols[char], symbols[char + suffix]
        self.inner, self.final = inner, final
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """Ids of a pre-split word; words met lately are remembered in two generations."""
        found = self.old.get(piece)
        if found is None:
            raw = piece.encode()
            symbols = list(map(self.inner.__getitem__, raw))
            symbols[-1] = self.final[raw[-1]]
            ids = self.automaton.encode(symbols)
            found = struct.pack(f"<{len(ids)}i", *ids)
        if len(self.young) > _CACHE:
            self.old, self.young = self.young, {}
        self.young[piece] = found
        return found

    def pieces(self, text: str) -> list[str]:
        """Words of a text as the vocabulary's normalizer and pre-split give them."""
        if _BEYOND.search(text):
            shown = self.pre.pre_tokenize_str(self.normalizer.normalize_str(text))
            to_byte = byte_chars()
            return [bytes(to_byte[c] for c in p).decode() for p, _ in shown]
        return _PIECES.findall(unicodedata.normalize("NFC", text).lower())

    def encode(self, text: bytes) -> bytes:
        """Ids of a text, as little-endian 32-bit integers."""
        whole, out = text.decode("utf-8", "replace"), []
        for part in self.cut.split(whole) if self.cut and "<|" in whole else (whole,):
            if part in self.special:
                out.append(struct.pack("<i", self.special[part]))
                continue
            get, piece = self.young.get, self._piece
            for p in self.pieces(part):
                found = get(p)
                if found is None:
                    found = piece(p)
                    get = self.young.get
                out.append(found)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        labels = self.labels
        return self.joint.join([labels[i] for i in ids if labels[i]])


def codec(path: str) -> Codec:
    return worker_cache(f"codec:{path}", lambda: Codec(path))


def id_lists(parts: list[bytes]) -> pa.Array:
    """List column of 32-bit ids from their bytes."""
    sizes = np.cumsum([0, *(len(p) // 4 for p in parts)])
    if sizes[-1] >= 1 << 31:
        raise ValueError("a slice of texts has more ids than an Arrow list can index")
    values = pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32())
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)


def encode(
    df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """Add the token ids of every whole text; null and empty texts give an empty list.

    With ``decoded`` named, the ids are decoded in the same pass, a slice of texts at a time.
    """
    fields = [StructField(ids, ArrayType(IntegerType(), False), False)]
    if decoded:
        fields.append(StructField(decoded, StringType(), False))

    def make():
        own = codec(path)

        def work(texts):
            parts = [own.encode(t) for t in texts]
            if not decoded:
                return [id_lists(parts)]
            back = [own.decode(np.frombuffer(p, "<i4").tolist()) for p in parts]
            return [id_lists(parts), pa.array(back, pa.string())]

        return work

    return map_text(df, text, fields, make)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text that the ids spell; null and empty lists give an empty text."""
    from pyspark.sql.types import StructType

    schema = StructType([*df.schema.fields, StructField(decoded, StringType(), False)])

    def run(batches):
        own = codec(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            texts = pa.array([own.decode(x or []) for x in _slow_lists(lists)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, decoded])

    return df.mapInArrow(run, schema)


def _slow_lists(lists: pa.Array):
    """Rows of a list column as Python lists, one at a time."""
    for i in range(len(lists)):
        yield lists[i].values.to_numpy(zero_copy_only=False).tolist() if lists[i].is_valid else None
