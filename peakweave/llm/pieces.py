"""SentencePiece encoding and decoding over a lattice of substrings.

Texts are cut into units, between characters that no piece joins, so that units are encoded independently.  The different
units form a lattice: bounded-length substrings are exploded, equi-joined to the piece table and grouped by unit, and
a fold picks each unit's pieces from its edges.

The model decides the fold.  A byte-pair model's library does not compute the best-scoring path: it repeats the
best-ranked merge of two neighbours.  The fold therefore replays merges over the lattice (state: the boundaries that
are left), which gives exactly the library's ids.  For a unigram model it is the Viterbi recursion over positions.

The lattice exists twice.  ``encode_units`` is relational: a DataFrame of units, ``explode``, a join with the piece table, ``groupBy``
and Spark's higher-order ``aggregate``.  ``encode`` runs the same steps over each batch's different units as numpy columns
(``Model.encode_many``): bringing the relational lexicon back to the documents takes a row for each different unit of each bundle of
documents, which the limits do not allow (see the README).  Documents are then not shuffled at all.
Units longer than LONGEST characters or with characters outside the vocabulary take the same merges (or the same
recursion) one at a time, the latter ending in byte pieces.

Defined cases: null texts have null ids, empty texts no ids; repeated rows are encoded each on their own; an
empty table gives an empty result; U+2581 in a text is decoded as a space, as the library does.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .textcore import POWERS, U64, codes_in, documents, free_name, mix64, trim

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONGEST = 48
#: Units in one lattice, characters of text encoded at once, and encoded units that a task remembers.
CHUNK = 8_192
PART = 1 << 20
KNOWN = 150_000
#: Ids decoded at once.
DECODED = 1 << 20
_KEY = 64  # more than LONGEST: an edge's key is start * _KEY + end
_ID_BITS = 20

#: Unit patterns, finest first; a model uses the first that leaves each of its pieces whole.
_LETTERS = "A-Za-zªµºÀ-῿Ⰰ-\U0010ffff"
PATTERNS = (f"{SPACE}*(?:[{_LETTERS}]+|[^{_LETTERS}{SPACE}]+)|{SPACE}+", f"{SPACE}*[^{SPACE}]+|{SPACE}+", "(?s:.+)")


class Model:
    """A piece table: pieces with ids and scores, byte pieces, and the unit pattern."""

    def __init__(self, source: bytes | str = MODEL) -> None:
        """From a model file's bytes, or its path."""
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_proto=source if isinstance(source, bytes) else read_model(source))
        n = s.get_piece_size()
        special = [s.is_byte(i) or s.is_control(i) or s.is_unknown(i) or s.is_unused(i) for i in range(n)]
        self.unigram = not self._merges(s)
        self.ids = {s.id_to_piece(i): i for i in range(n) if not special[i]}
        self.score = {p: s.get_score(i) for p, i in self.ids.items()}
        steps = {v: k for k, v in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: steps[v] for p, v in self.score.items()}
        self.bytes = [s.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = s.unk_id()
        self.has_bytes = any(s.is_byte(i) for i in range(n))
        self.longest = max(map(len, self.ids))
        self.units = next(p for p in map(re.compile, PATTERNS) if all(p.findall(x) == [x] for x in self.ids))
        self.alphabet = {p for p in self.ids if len(p) == 1}
        self._table = None
        decoded = [self._decoded(s, i) for i in range(n)]
        size = np.array([len(p) for p in decoded], np.int64)
        self._bytes = size, np.cumsum(size) - size, np.frombuffer(b"".join(decoded), np.uint8)

    @staticmethod
    def _merges(s) -> bool:
        """Whether the model is of byte pairs: its file's trainer specification says so."""
        try:
            from sentencepiece import sentencepiece_model_pb2 as pb

            m = pb.ModelProto()
            m.ParseFromString(s.serialized_model_proto())
            return m.trainer_spec.model_type == 2
        except ImportError:
            return all(float(s.get_score(i)).is_integer() for i in range(s.get_piece_size()))

    def _decoded(self, s, i: int) -> bytes:
        if s.is_byte(i):
            return bytes([int(s.id_to_piece(i)[3:5], 16)])
        if s.is_control(i):
            return b""
        if s.is_unknown(i):
            return b" \xe2\x81\x87 "
        return s.id_to_piece(i).replace(SPACE, " ").encode()

    def split(self, text: str) -> list[str]:
        return self.units.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def plain(self, unit: str) -> bool:
        """Whether the lattice encodes the unit."""
        return len(unit) <= LONGEST and self.alphabet.issuperset(unit)

    def encode_unit(self, unit: str) -> list[int]:
        """The same encoding in Python, for any unit."""
        parts = self._viterbi(unit) if self.unigram else self._merged(unit)
        out: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.bytes[b] for b in p.encode()] if self.has_bytes else [self.unknown]
        return out

    def encode_many(self, units: list[str]) -> list[bytes]:
        """The ids, as int32 bytes, of units that the lattice encodes (``plain``), column by column."""
        if self.unigram:
            return [np.array(self.encode_unit(u), np.int32).tobytes() for u in units]
        out: list[bytes] = []
        for i in range(0, len(units), CHUNK):
            out += self._lattice_merges(units[i : i + CHUNK])
        return out

    def decode(self, lists: pa.ListArray) -> list[str | None]:
        """The texts of lists of ids: piece bytes end to end, without the first space."""
        size, start, blob = self._bytes
        flat = lists.flatten().to_numpy()
        n = size[flat]
        done = np.cumsum(n)
        raw = blob[np.repeat(start[flat] - (done - n), n) + np.arange(int(done[-1]) if len(done) else 0)].tobytes()
        out: list[str | None] = []
        k = p = 0
        for ids in lists.value_lengths().to_pylist():
            if ids is None:
                out.append(None)
                continue
            k += ids
            end = int(done[k - 1]) if k else 0
            text = raw[p:end]
            out.append((text[1:] if text[:1] == b" " else text).decode("utf-8", "replace"))
            p = end
        return out

    def _joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The piece table by hash: sorted hashes, ranks, ids, lengths in characters."""
        if self._table is None:
            pieces = sorted(self.ids)
            size = np.array([len(p) for p in pieces], np.int64)
            hashes = self._hashes(np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32), np.cumsum(size) - size, size)
            order = np.argsort(hashes)
            if len(np.unique(hashes)) != len(hashes):
                raise ValueError("two pieces have one hash")
            rank = np.array([self.rank[p] for p in pieces], np.int64)
            ids = np.array([self.ids[p] for p in pieces], np.int64)
            self._table = hashes[order], rank[order], ids[order], size[order]
        return self._table

    @staticmethod
    def _totals(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, down = POWERS.upto(len(chars) + 1)
        total = np.zeros(len(chars) + 1, U64)
        np.cumsum(mix64(chars.astype(U64) + U64(0x51ED270B)) * up[: len(chars)], out=total[1:])
        return total, down

    def _hashes(self, chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        total, down = self._totals(chars)
        return mix64((total[start + size] - total[start]) * down[start])

    def _lattice_merges(self, units: list[str]) -> list[bytes]:
        hashes, ranks, ids, sizes = self._joined()
        n = np.array([len(u) for u in units], np.int64)
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        begin = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(units)), n)
        at = np.arange(len(chars)) - begin[owner]
        left = n[owner] - at
        total, down = self._totals(chars)
        # explode substrings by length and join them to the pieces; edges by unit, start and end
        width = n + 1
        base = np.cumsum(width * width) - width * width
        edge = np.full(int((width * width).sum()), -1, np.int32)
        place = np.arange(len(chars))
        for k in range(1, min(self.longest, int(n.max(initial=0))) + 1):
            place = place[left[place] >= k]
            code = codes_in(mix64((total[place + k] - total[place]) * down[place]), hashes)
            hit = np.flatnonzero(code)
            piece = code[hit] - 1
            same = sizes[piece] == k
            p, piece = place[hit[same]], piece[same]
            u, s = owner[p], at[p]
            edge[base[u] + s * width[u] + s + k] = piece
        # fold: the boundaries that are left, all units at once; each round merges one pair of every unit that has one
        pos = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
        unit = np.repeat(np.arange(len(units)), width)
        rank_of = np.append(ranks, 1 << 30)
        done_pos, done_unit = [], []
        while len(pos):
            first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            key = np.full(len(pos), 1 << 62, np.int64)
            inner = np.flatnonzero((unit[1:-1] == unit[:-2]) & (unit[1:-1] == unit[2:])) + 1
            u = unit[inner]
            found = rank_of[edge[base[u] + pos[inner - 1] * width[u] + pos[inner + 1]]]
            key[inner] = (found << 32) | inner
            best = np.minimum.reduceat(key, first)
            merges = best < (1 << 62)  # no piece: rank 1 << 30
            gone = np.zeros(len(pos), bool)
            gone[best[merges] & 0xFFFFFFFF] = True
            ended = np.zeros(len(units), bool)
            ended[unit[first[~merges]]] = True
            over = ended[unit]
            done_pos.append(pos[over])
            done_unit.append(unit[over])
            keep = ~(over | gone)
            pos, unit = pos[keep], unit[keep]
        pos, unit = np.concatenate(done_pos), np.concatenate(done_unit)
        order = np.argsort(unit, kind="stable")
        pos, unit = pos[order], unit[order]
        inside = np.flatnonzero(unit[1:] == unit[:-1])
        u = unit[inside]
        flat = ids[edge[base[u] + pos[inside] * width[u] + pos[inside + 1]]].astype(np.int32).tobytes()
        ends = (np.cumsum(np.bincount(u, minlength=len(units))) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merged(self, unit: str) -> list[str]:
        n = len(unit)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        rank, heap, live = self.rank, [], [True] * n

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := rank.get(unit[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, e, f = heapq.heappop(heap)
            j = after[i]
            if not live[i] or end[i] != e or j >= n or end[j] != f:
                continue
            end[i], after[i], live[j] = f, after[j], False
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(unit[i : end[i]])
            i = after[i]
        return out

    def _viterbi(self, unit: str) -> list[str]:
        n, worst = len(unit), min(self.score.values()) - 10
        best: list[tuple[float, int]] = [(0.0, 0)]
        for e in range(1, n + 1):
            options = [(best[s][0] + self.score[unit[s:e]], -s) for s in range(max(0, e - self.longest), e) if unit[s:e] in self.score]
            if unit[e - 1] not in self.score:
                options.append((best[e - 1][0] + worst, -(e - 1)))
            value, s = max(options)
            best.append((value, -s))
        out, e = [], n
        while e:
            out.append(unit[best[e][1] : e])
            e = best[e][1]
        return out[::-1]


@lru_cache(4)
def model_of(proto: bytes) -> Model:
    return Model(proto)


def read_model(path: str = MODEL) -> bytes:
    """A model's file, read in the driver; tasks are sent its bytes (under a megabyte) and need no file."""
    with open(path, "rb") as file:
        return file.read()


def model_at(path: str = MODEL) -> Model:
    return model_of(read_model(path))


# ------------------------------------------------------------------------------------------- lattice


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """(piece, value, score): value holds rank and id.  As many rows as the vocabulary file has pieces."""
    pieces = sorted(model.ids)
    value = [(model.rank[p] << _ID_BITS) | model.ids[p] for p in pieces]
    return spark.createDataFrame(pa.table({"piece": pieces, "value": pa.array(value, pa.int64()), "score": pa.array([float(model.score[p]) for p in pieces])}))


def lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(unit, n, edges, scores): of each distinct unit, its substrings that are pieces, by start * 64 + end."""
    spots = units.select("unit", F.length("unit").alias("n")).select("unit", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
    reach = F.least(F.lit(longest), F.col("n") - F.col("s"))
    spans = spots.select("unit", "s", F.explode(F.sequence(F.lit(1), reach)).alias("k"))
    parts = spans.select("unit", (F.col("s") * _KEY + F.col("s") + F.col("k")).alias("key"), F.substring("unit", F.col("s") + 1, F.col("k")).alias("piece"))
    edges = parts.join(F.broadcast(pieces), "piece").select("unit", "key", "value", "score")  # the vocabulary's size
    grouped = edges.groupBy("unit").agg(F.collect_list(F.struct("key", "value", "score")).alias("e"))
    as_map = lambda v: F.map_from_entries(F.transform("e", lambda x: F.struct(x["key"], x[v])))
    return grouped.select("unit", F.length("unit").alias("n"), as_map("value").alias("edges"), as_map("score").alias("scores"))


def fold_merges() -> Column:
    """Boundaries of the pieces after all merges: at each step the best-ranked pair of neighbours, the leftmost of equals, becomes one."""
    none = 1 << 62
    step = f"""
      aggregate(sequence(1, n), sequence(0, n), (b, x) ->
        CASE WHEN size(b) <= 2 THEN b ELSE
          element_at(transform(
            array(array_min(transform(sequence(1, size(b) - 2), i -> coalesce(shiftleft(shiftright(edges[b[i - 1] * {_KEY} + b[i + 1]], {_ID_BITS}), 8) + i, {none}L)))),
            best -> CASE WHEN best = {none}L THEN b ELSE filter(b, (v, j) -> j <> cast(best & 255L AS int)) END), 1)
        END)
    """
    return F.expr(step)


def fold_viterbi(longest: int) -> Column:
    """Boundaries of the best-scoring path: for each end in turn the best start, kept with its score; then walked back."""
    forward = f"""
      aggregate(sequence(1, n), array(named_struct('v', 0.0D, 's', 0)), (t, e) ->
        concat(t, array(array_max(transform(
          filter(sequence(greatest(0, e - {longest}), e - 1), s -> scores[s * {_KEY} + e] IS NOT NULL),
          s -> named_struct('v', t[s].v + scores[s * {_KEY} + e], 's', s))))))
    """
    back = f"""
      element_at(transform(array({forward}), t ->
        reverse(aggregate(sequence(1, n), array(n), (b, x) -> CASE WHEN element_at(b, -1) = 0 THEN b ELSE concat(b, array(t[element_at(b, -1)].s)) END))), 1)
    """
    return F.expr(back)


def encode_units(units: DataFrame, model: Model) -> DataFrame:
    """(unit, ids) of distinct units that the lattice encodes (``Model.plain``)."""
    pieces = piece_table(units.sparkSession, model)
    bounds = fold_viterbi(model.longest) if model.unigram else fold_merges()
    cut = lattice(units, pieces, model.longest).select("unit", "edges", bounds.alias("b"))
    ids = F.expr(f"transform(sequence(1, size(b) - 1), i -> cast(edges[b[i - 1] * {_KEY} + b[i]] & {(1 << _ID_BITS) - 1}L AS int))")
    return cut.select("unit", ids.alias("ids"))


# ------------------------------------------------------------------------------------------- documents


def encode(df: DataFrame, text: str = "text", path: str = MODEL, check: bool = False) -> tuple[DataFrame, str]:
    """Every row with an array column of its piece ids; or, with ``check``, a struct of ``ids`` and whether they decode to the text."""
    name = free_name(df, "piece_ids")
    at = df.columns.index(text)
    ids_type = ArrayType(IntegerType())
    kind = StructType([StructField("ids", ids_type), StructField("same", BooleanType())]) if check else ids_type
    shared = df.sparkSession.sparkContext.broadcast(read_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value)
        known: dict[str, bytes] = {}
        for batch in batches:
            first = 0
            while first < batch.num_rows:
                texts, size = [], 0
                while first + len(texts) < batch.num_rows and size < PART:
                    texts.append(batch.column(at)[first + len(texts)].as_py())
                    size += len(texts[-1] or "")
                part = batch.slice(first, len(texts))
                first += len(texts)
                ids = _encoded(model, texts, known)
                if check:
                    same = pa.array([x == y for x, y in zip(texts, model.decode(ids), strict=True)])
                    ids = pa.StructArray.from_arrays([ids, same], names=["ids", "same"])
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, name])
        trim()

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, kind)])), name


def _encoded(model: Model, texts: list[str | None], known: dict[str, bytes]) -> pa.Array:
    """Piece ids of some texts; ``known`` keeps encoded units from one call to the next, KNOWN of them at most."""
    split = [model.split(x or "") for x in texts]
    new = set().union(*split).difference(known)
    if len(known) + len(new) > KNOWN:
        known.clear()
        new = set().union(*split)
    plain = [u for u in new if model.plain(u)]
    known.update(zip(plain, model.encode_many(plain), strict=True))
    for u in new.difference(plain):
        known[u] = np.array(model.encode_unit(u), np.int32).tobytes()
    out = [b"".join([known[u] for u in units]) for units in split]
    missing = [x is None for x in texts]
    offsets = pa.array(np.r_[0, np.cumsum([len(x) // 4 for x in out])].astype(np.int32), mask=np.r_[missing, False] if any(missing) else None)
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(out), np.int32)))


def decode(df: DataFrame, ids: str, path: str = MODEL) -> tuple[DataFrame, str]:
    """Every row with a string column: the text of its piece ids."""
    name = free_name(df, "decoded")
    at = df.columns.index(ids)
    shared = df.sparkSession.sparkContext.broadcast(read_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value)
        for batch in batches:
            ends = np.cumsum(np.nan_to_num(np.array(batch.column(at).value_lengths().to_numpy(zero_copy_only=False), float)))
            first = 0
            while first < batch.num_rows:
                # rows of about DECODED ids at once, or one longer row
                upto = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + DECODED, "right")))
                part = batch.slice(first, upto - first)
                first = upto
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.decode(part.column(at)), pa.string())], names=[*part.schema.names, name])
        trim()

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, StringType())])), name


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece counts, a hash of the piece ids and whether they decode to the text, of every document."""
    encoded, name = encode(documents(spark, sf_dir).select("doc_id", "text"), check=True)
    x = F.col(name)
    return encoded.select("doc_id", F.coalesce(F.size(x["ids"]), F.lit(0)).cast("bigint").alias("n_pieces"), F.xxhash64(x["ids"]).alias("ids_xxhash64"), x["same"].alias("round_trip"))
