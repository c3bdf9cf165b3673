"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled once into parts that are composed with each input:

- the normaliser, a transducer that reads the longest entry of the model's character map and writes its replacement, drops
  or folds spaces, puts a space before the text and escapes spaces;
- the lexicon, a trie of pieces; an arc that completes a piece writes its id at the cost of its negated score;
- the byte fallback, whose arcs read one character that is no piece and write its bytes, at a cost above that of any piece.

A path through the composition is a segmentation; the encoding is the path of least total cost: states are relaxed in order
of position, sums of costs along paths and minima over paths (the tropical semiring). For a unigram model a state is a
position (of equally cheap paths, which the library tells apart by rounding, any is taken). A byte-pair model's segmentation is defined by merges, not by a sum of scores, so its lexicon is also composed
with an acceptor of compatible neighbours, whose state is the last piece: piece b may follow piece a only if merging the
characters of ab gives a, b again. A segmentation all of whose neighbours are compatible is the one that merging gives.

Where two characters meet that are neighbours in no piece, such as a letter and a space, every path passes. A batch is cut
there, and each distinct stretch is looked for once; a worker keeps a bounded table of paths.

Defined cases: null text gives null ids; the empty text has none. Lone bytes decode to U+FFFD, as in the library. Only models
with user-defined pieces are refused. A column of the name asked for is replaced; all others are passed through.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm._spark import small_batches
from folioscope.llm._words import buffers, slices

#: Place of the model unless another is given.
MODEL = os.environ.get("FOLIOSCOPE_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Stretches whose paths a worker keeps, and as many that it found before those; pairs of pieces as well.
KEPT = 1 << 17
SPACE = "▁"
#: Number of the acceptor's first state.
START = -1
COST = itemgetter(1)
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        elif kind == 2:
            n = number()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


def character_map(blob: bytes) -> dict[str, str]:
    """The entries of a model's character map: a double-array trie of what is read, then the texts that are written."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob[4 : 4 + size], "<u4"), blob[4 + size :]
    offset = (units >> 10) << ((units & (1 << 9)) >> 6)
    label = units & np.uint32(0x800000FF)
    leaf = (units >> 8) & 1
    letters = np.arange(1, 256)
    found: dict[str, str] = {}
    open_ = [(int(offset[0]), b"")]
    while open_:
        at, read = open_.pop()
        places = at ^ letters
        inside = places < len(units)
        places, heads = places[inside], letters[inside]
        for place, c in zip(places[label[places] == heads].tolist(), heads[label[places] == heads].tolist(), strict=True):
            below = place ^ int(offset[place])
            if leaf[place]:
                start = int(units[below]) & 0x7FFFFFFF
                found[(read + bytes([c])).decode()] = texts[start : texts.index(b"\0", start)].decode()
            open_.append((below, read + bytes([c])))
    return found


class Transducer:
    """A compiled model."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.type, self.dummy, self.trim, self.escape = UNIGRAM, True, True, True
        self.map: dict[str, str] = {}
        for field, value in _fields(model):
            if field == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, NORMAL))
            elif field == 2:
                self.type = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                f = dict(_fields(value))
                self.map = character_map(f.get(2, b""))
                self.dummy, self.trim, self.escape = (bool(f.get(k, 1)) for k in (3, 4, 5))
        if self.type not in (UNIGRAM, BPE) or USER in self.kinds:
            raise ValueError("only unigram and byte-pair models without user-defined pieces can be compiled")
        self.id = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.cost = {p: -scores[i] for p, i in self.id.items()}
        self.longest = max(map(len, self.map), default=0)
        self.mapped = {k[0] for k in self.map}
        # the lexicon, read from the end of a piece: of each state the arcs by character, to the state after it and to the
        # piece that is read there (-1: none) with its cost
        self.lexicon: dict[str, tuple[dict, int, float]] = {}
        for p, weight in sorted(self.cost.items(), key=lambda x: len(x[0]), reverse=True):
            arcs = self.lexicon
            for ch in p[:0:-1]:
                arcs = arcs.setdefault(ch, ({}, -1, 0.0))[0]
            arcs[p[0]] = (arcs[p[0]][0] if p[0] in arcs else {}, self.id[p], weight)
        # neighbours inside a piece, as bytes of normalised texts; where others meet, every path passes
        self.joined = np.ones((256, 256), bool)
        self.joined[:128, :128] = False
        for p in self.id:
            text = p.replace(SPACE, " ") if self.escape else p
            for a, b in zip(text, text[1:], strict=False):
                if a < "\x80" and b < "\x80":
                    self.joined[ord(a), ord(b)] = True
        # pieces that merging their own characters gives
        self.whole = {p for p in self.id if self.type == UNIGRAM or self.merged(p) == [p]}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.dearest = max(self.cost.values(), default=0.0) + 10.0
        output = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for i, k in enumerate(self.kinds):
            if k == BYTE:
                output[i] = bytes([int(self.pieces[i][3:5], 16)])
            elif k == CONTROL:
                output[i] = b""
            elif k == UNKNOWN:
                output[i] = " ⁇ ".encode()
        self.output_at = np.append(0, np.cumsum([len(x) for x in output]))
        self.output = np.frombuffer(b"".join(output), np.uint8)
        self.after: defaultdict[int, dict[int, bool]] = defaultdict(dict)
        self.pairs = 0
        self.paths: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def mapped_text(self, text: str) -> str:
        """The longest entry of the character map at each place is replaced."""
        if not self.map or self.mapped.isdisjoint(text):
            return text
        out, at = [], 0
        while at < len(text):
            for n in range(min(self.longest, len(text) - at) if text[at] in self.mapped else 0, 0, -1):
                to = self.map.get(text[at : at + n])
                if to is not None:
                    out.append(to)
                    at += n
                    break
            else:
                out.append(text[at])
                at += 1
        return "".join(out)

    def normalised(self, texts: pa.Array) -> pa.Array:
        """Normalised texts, in which a space stands for an escaped one; nulls are empty."""
        texts = pc.fill_null(texts, "")
        if self.map:
            texts = pa.array([self.mapped_text(t) for t in texts.to_pylist()], texts.type)
        if self.trim:
            texts = pc.utf8_trim(pc.replace_substring_regex(texts, " +", " "), " ")
        if self.dummy:
            texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar(" ", texts.type)))
        return pc.replace_substring(texts, SPACE, " ") if self.escape else texts

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: the best-scored neighbour pair first, the leftmost of equals."""
        cost, none = self.cost.get, float("inf")
        parts = list(text)
        costs = [cost(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while costs:
            least = min(costs)
            if least == none:
                break
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = cost(parts[i] + parts[i + 1], none)
            if i:
                costs[i - 1] = cost(parts[i - 1] + parts[i], none)
        return parts

    def name(self, piece: int) -> str:
        """Of a piece's id, or of a character without piece, which is numbered after all pieces."""
        return self.pieces[piece] if piece < len(self.pieces) else chr(piece - len(self.pieces))

    def follows(self, a: int, b: int) -> bool:
        """An arc of the acceptor: whether piece b can come after a, or first (a = START)."""
        second = self.name(b)
        if a == START:
            found = len(second) == 1 or second in self.whole
        else:
            first = self.name(a)
            found = first + second not in self.whole and self.merged(first + second) == [first, second]
        self.pairs += 1
        if self.pairs > 2 * KEPT:
            self.pairs = 0
            for known in self.after.values():
                known.clear()
        self.after[a][b] = found
        return found

    def shortest_paths(self, texts: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Each text with the pieces, and numbers of single characters without one, of the least-cost path over it. texts are
        sorted and normalised.

        A state of the composition is a position and a state of the acceptor, which is the last piece (of a unigram model:
        always the start). It is held as (piece, least cost of reaching it, state before it, what the acceptor knows). The
        states at a position depend on the text before it only, so those of a prefix shared with the text before stay."""
        pairs, none, dearest, root = self.type == BPE, len(self.pieces), self.dearest, self.lexicon
        states: list[list[tuple]] = [[(START, 0.0, None, self.after[START])]]
        before = ""
        for text in texts:
            shared, n = 0, min(len(text), len(before))
            while shared < n and text[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                here, arcs, at = [], root, end
                while at:
                    at -= 1
                    arc = arcs.get(text[at])
                    if arc is None:
                        if at < end - 1:
                            break
                        piece, weight = none + ord(text[at]), dearest
                    else:
                        arcs, piece, weight = arc
                        if piece < 0:
                            if at < end - 1:
                                continue
                            piece, weight = none + ord(text[at]), dearest
                    low = None
                    for state in states[at]:
                        if pairs:
                            fits = state[3].get(piece)
                            if fits is None:
                                fits = self.follows(state[0], piece)
                            if not fits:
                                continue
                        if low is None or state[1] < low[1]:
                            low = state
                    if low is not None:
                        here.append((piece, low[1] + weight, low, self.after[piece] if pairs else None))
                    if arc is None:
                        break
                if not pairs:
                    here = [min(here, key=COST)]
                states.append(here)
            state, path = min(states[len(text)], key=COST), []
            while state[2] is not None:
                path.append(state[0])
                state = state[2]
            yield text, path[::-1]
            before = text

    def ids(self, path: list[int]) -> list[int]:
        """The ids that a path writes."""
        none = len(self.pieces)
        if not path or max(path) < none:
            return path
        out: list[int] = []
        for piece in path:
            if piece < none:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[b] for b in self.name(piece).encode()]
            else:
                out.append(self.unknown)
        return out

    def paths_of(self, stretches: list[str]) -> list[bytes]:
        """The ids of stretches with spaces for escaped ones, as 32-bit numbers; those of short ones are kept."""
        found = {x: y for x in stretches if (y := self.paths.get(x) or self.earlier.get(x))}
        new = {x.replace(" ", SPACE) if self.escape else x: x for x in stretches if x not in found}
        for text, path in self.shortest_paths(sorted(new)):
            found[new[text]] = struct.pack(f"{len(ids := self.ids(path))}i", *ids)
        for x, y in found.items():
            if len(x) <= 64:
                if len(self.paths) >= KEPT:
                    self.earlier, self.paths = self.paths, {}
                self.paths[x] = y
        return [found[x] for x in stretches]

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the bounds of each text's."""
        data, off = buffers(self.normalised(texts))
        head = np.zeros(len(data), bool)
        head[1:] = ~self.joined[data[:-1], data[1:]]
        head[off[:-1][np.diff(off) > 0]] = True
        starts = np.flatnonzero(head)
        cuts = np.append(starts, len(data)).astype(np.int32)
        stretches = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode()
        paths = self.paths_of(stretches.dictionary.to_pylist())
        size = np.array([len(p) for p in paths], np.int64) // 4
        first = np.append(0, np.cumsum(size))
        which = stretches.indices.to_numpy()
        flat = np.frombuffer(b"".join(paths), np.int32)[ranges(first[which], size[which])]
        ends = np.append(0, np.cumsum(size[which]))
        return flat, ends[np.searchsorted(starts, off)]

    def decoded(self, flat: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each text."""
        size = np.diff(self.output_at)[flat]
        data = self.output[ranges(self.output_at[flat], size)].tobytes()
        ends = np.append(0, np.cumsum(size))[bounds]
        out = [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        if not self.dummy:
            return out
        # the space before the text is that of a piece, not one around the mark of an unknown one
        silent = np.diff(self.output_at)[flat] == 0
        first = np.minimum(bounds[:-1] + [int((~silent[a:b]).argmax()) if b > a and silent[a] else 0 for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], len(flat) - 1)
        own = flat[first] != self.unknown if len(flat) else np.zeros(len(out), bool)
        return [x[1:] if y and x.startswith(b" ") else x for x, y in zip(out, own.tolist(), strict=True)]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


@lru_cache(maxsize=2)
def compiled(model: bytes) -> Transducer:
    return Transducer(model)


def model_bytes(path: str) -> bytes:
    """A model is read by the driver and goes to the tasks with their code: half a megabyte."""
    with open(path, "rb") as f:
        return f.read()


def encode_column(fst: Transducer, texts: pa.Array) -> pa.ListArray:
    flat, bounds = fst.encoded(texts)
    null = np.append(texts.is_null().to_numpy(zero_copy_only=False), False)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), mask=null), pa.array(flat))


def decode_column(fst: Transducer, ids: pa.ListArray) -> pa.Array:
    null = ids.is_null().to_numpy(zero_copy_only=False)
    size = np.where(null, 0, pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
    found = fst.decoded(ids.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(size)))
    return pa.array([None if z else x.decode(errors="replace") for z, x in zip(null, found, strict=True)], pa.string())


def _with_column(docs: DataFrame, model: str, of: str, to: str, kind: str, made: Callable[[Transducer, pa.Array], pa.Array]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(model))
    names = docs.columns
    kept = [i for i, c in enumerate(names) if c != to]
    schema = ", ".join([*(f"`{docs.schema[i].name}` {docs.schema[i].dataType.simpleString()}" for i in kept), f"`{to}` {kind}"])
    text = docs.schema[of].dataType.typeName() == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(shared.value)
        for part in slices(batches, of) if text else batches:
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), made(fst, part.column(names.index(of)))], [*(names[i] for i in kept), to])

    return small_batches(docs).mapInArrow(run, schema)


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", to: str = "ids") -> DataFrame:
    """docs with the ids of the text column; all other columns stay."""
    return _with_column(docs, model, text, to, "array<int>", encode_column)


def decode(docs: DataFrame, model: str = MODEL, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """docs with the text of the ids column; all other columns stay."""
    return _with_column(docs, model, ids, to, "string", decode_column)


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_sha256 (of little-endian 32-bit ids), round_trip (decoding gives the text).
    For a null text the last two are null. Ids don't leave the worker that makes them."""
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(shared.value)
        low, high = (min(fst.bytes.values()), max(fst.bytes.values())) if fst.bytes else (0, -1)
        for part in slices(batches):
            texts = part.column(1)
            flat, bounds = fst.encoded(texts)
            null = texts.is_null().to_numpy(zero_copy_only=False)
            fallback = np.append(0, np.cumsum((flat >= low) & (flat <= high)))
            data, at = memoryview(flat.astype("<i4").tobytes()), (4 * bounds).tolist()
            sha = [None if z else hashlib.sha256(data[a:b]).hexdigest() for z, a, b in zip(null, at[:-1], at[1:], strict=True)]
            raw, off = buffers(texts)
            given, off = raw.tobytes(), off.tolist()
            same = [None if z else x == given[a:b] for z, x, a, b in zip(null, fst.decoded(flat, bounds), off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds).astype(np.int64)), pa.array(np.diff(fallback[bounds]).astype(np.int64)), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
