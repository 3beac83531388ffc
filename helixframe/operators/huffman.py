"""Huffman coding of payloads, with a code book for each row, or for each group of rows (a language, the whole table)."""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import flat
from ..sources.folders import shared
from . import pieces

#: Bytes of a payload that are turned into bits at once, and bits that one table lookup decodes.
CHUNK, LOOKUP = 1 << 16, 12
#: Rows of code books that are broadcast; of more the payloads are shuffled, each group over SALTS keys.
GROUPS, SALTS = 10_000, 32
_LETTERS = np.frombuffer(b"ATCG", np.uint8)
_NONE = np.iinfo(np.int64).max


def _counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how often, where first) each byte occurs in each value, as matrices of values by bytes; no place is `_NONE`."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    key = row * 256 + data
    first = np.full(rows * 256, _NONE)
    first[key[::-1]] = (np.arange(len(data)) - offsets[row])[::-1]  # of places with one key the last written stays, which is the first
    return np.bincount(key, minlength=rows * 256).reshape(rows, 256), first.reshape(rows, 256)


def byte_frequencies(df: DataFrame, group: str, content: str = "content", order: str | None = None) -> DataFrame:
    """(group, byte, n, first): how often each byte occurs in a group, and where it occurs first.

    Places count within the row; in groups of several rows `order`, a column of numbers, texts or dates, says which row is
    earlier.  Bytes are counted by batches, so that 256 rows for each group of a batch are what is shuffled at most.
    """
    cols = [F.col(group).alias("g"), (F.col(order) if order else F.lit(0)).alias("o"), F.col(content).alias("c")]
    narrow = df.select(*cols)
    g, o = (narrow.schema[c].dataType.simpleString() for c in "go")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = flat.large(batch.column("c"))
            for start, past in flat.pieces(column):
                groups = batch.column("g").slice(start, past - start).dictionary_encode("encode")
                orders = batch.column("o").slice(start, past - start)
                rank = pc.rank(orders, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64) - 1
                n, first = _counted(*flat.values(column.slice(start, past - start)))
                which = groups.indices.to_numpy()
                total = np.zeros((len(groups.dictionary), 256), np.int64)
                early = np.full(total.shape, _NONE)
                np.add.at(total, which, n)
                np.minimum.at(early, which, np.where(n > 0, rank[:, None] << 31 | first, _NONE))  # a value has fewer than 2^31 bytes
                where, byte = np.nonzero(total)
                at = early[where, byte]
                row_of = np.zeros(rank.max(initial=-1) + 1, np.int64)
                row_of[rank] = np.arange(len(rank))
                out = [groups.dictionary.take(pa.array(where)), pa.array(byte.astype(np.int32)), pa.array(total[where, byte]), orders.take(pa.array(row_of[at >> 31])), pa.array((at & (1 << 31) - 1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, ["g", "byte", "n", "o", "pos"])

    parts = narrow.mapInArrow(counts, f"g {g}, byte int, n long, o {o}, pos int")
    return parts.groupBy(F.col("g").alias(group), "byte").agg(F.sum("n").alias("n"), F.min(F.struct("o", "pos")).alias("first"))


def codes_of(weights: list[int]) -> list[str]:
    """Prefix-free codes, 0 for the lighter branch, of symbols in order of first appearance; ties go to what is older."""
    if len(weights) == 1:
        return ["0"]
    age = itertools.count()
    queue = [(w, next(age), [i]) for i, w in enumerate(weights)]
    heapq.heapify(queue)
    out = [""] * len(weights)
    while len(queue) > 1:
        light, heavy = heapq.heappop(queue), heapq.heappop(queue)
        for digit, (_, _, members) in (("0", light), ("1", heavy)):
            for i in members:
                out[i] = digit + out[i]
        heapq.heappush(queue, (light[0] + heavy[0], next(age), light[2] + heavy[2]))
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def _codes(weights: pa.Array) -> pa.Array:
    return pa.array([codes_of(w) if w else w for w in weights.to_pylist()], pa.list_(pa.string()))


def code_books(frequencies: DataFrame, group: str) -> DataFrame:
    """(group, byte, code) from `byte_frequencies`; a group has 256 rows at most."""
    books = frequencies.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("first", "byte", "n"))).alias("_book"))
    coded = books.select(group, "_book", _codes(F.col("_book.n")).alias("_codes"))
    return coded.select(group, F.explode(F.arrays_zip(F.col("_book.byte").alias("byte"), F.col("_codes").alias("code"))).alias("_e")).select(group, "_e.byte", "_e.code")


def code_lengths(books: DataFrame, *by: str) -> DataFrame:
    """(by..., length, n_codes): how many codes have each length, ascending."""
    return books.groupBy(*by, F.length("code").alias("length")).agg(F.count("*").alias("n_codes")).orderBy(*by, "length")


def _spelled(book: dict[int, str]) -> tuple[np.ndarray, np.ndarray]:
    """By byte, the bits of its code and which of the columns these fill."""
    bits = np.zeros((256, max(map(len, book.values()), default=1)), np.uint8)
    used = np.zeros(bits.shape, bool)
    for byte, code in book.items():
        bits[byte, : len(code)] = np.frombuffer(code.encode(), np.uint8) - 48
        used[byte, : len(code)] = True
    return bits, used


@lru_cache(64)
def _parsed(codes: str) -> tuple[np.ndarray, np.ndarray]:
    return _spelled({i: code for i, code in enumerate(codes.split(",")) if code})


def _to_dna(content: np.ndarray, bits: np.ndarray, used: np.ndarray) -> tuple[bytes, int]:
    """Nucleotides of the codes of all bytes, and how many zero bits were added."""
    parts = [bits[c][used[c]] for c in (content[i : i + CHUNK] for i in range(0, len(content), CHUNK))]
    padding = sum(map(len, parts)) % 2
    whole = np.concatenate([*parts, np.zeros(padding, np.uint8)])
    return _LETTERS[whole[::2] << 1 | whole[1::2]].tobytes(), padding


@F.arrow_udf(T.StructType().add("dna", T.StringType()).add("padding", T.IntegerType()))
def _encoded(content: pa.Array, codes: pa.Array) -> pa.Array:
    out = [(None, None) if c.as_py() is None else _to_dna(np.frombuffer(c.as_py(), np.uint8), *_parsed(k or "")) for c, k in zip(content, codes.to_pylist())]
    return pa.StructArray.from_arrays([pa.array([d for d, _ in out], pa.string()), pa.array([p for _, p in out], pa.int32())], ["dna", "padding"])


#: A code table in Arrow.
TABLE = pa.map_(pa.string(), pa.string())


def encoded_alone(content: pa.Array) -> pa.Array:
    """(dna, table, padding) of a batch, a code book for each payload."""
    dna, tables, paddings = [], [], []
    for value in content:
        if value.as_py() is None:
            dna.append(None), tables.append([]), paddings.append(None)
            continue
        data = np.frombuffer(value.as_py(), np.uint8)
        n, first = _counted(data, np.array([0, len(data)]))
        symbols = np.flatnonzero(n[0])
        symbols = symbols[np.argsort(first[0][symbols])]
        book = dict(zip(symbols.tolist(), codes_of(n[0][symbols].tolist()))) if len(symbols) else {}
        text, padding = _to_dna(data, *_spelled(book))
        dna.append(text), tables.append([(str(b), book[b]) for b in sorted(book)]), paddings.append(padding)
    return pa.StructArray.from_arrays([pa.array(dna, pa.string()), pa.array(tables, TABLE), pa.array(paddings, pa.int32())], ["dna", "table", "padding"])


_encoded_alone = F.arrow_udf(encoded_alone, T.StructType().add("dna", T.StringType()).add("table", T.MapType(T.StringType(), T.StringType())).add("padding", T.IntegerType()))


def encode_each(content: Column) -> Column:
    """(dna, table MAP<STRING, STRING>, padding INT), with a code book of each payload's own: narrow, and fit for streams.

    An empty payload has '', an empty table and 0; a null one has null, an empty table and null.
    """
    return _encoded_alone(content)


def _slots(books: DataFrame, group: str) -> DataFrame:
    """One row for each group: codes by byte, 256 of them joined by commas, and the table with the bytes as text."""
    table = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("byte"), F.col("code")))))
    rows = books.groupBy(group).agg(table.alias("_map"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.coalesce(F.element_at("_map", b), F.lit("")))
    named = F.map_from_entries(F.transform(F.map_entries("_map"), lambda e: F.struct(e["key"].cast("string"), e["value"])))
    return rows.select(F.col(group).alias("_group"), F.array_join(slots, ",").alias("_codes"), named.alias("table"))


def encode(df: DataFrame, group: str, content: str = "content", order: str | None = None, groups: int = GROUPS) -> DataFrame:
    """df with dna, table MAP<STRING, STRING> and padding INT added; an empty payload has '', an empty table and 0.

    All payloads of a group share its code book; a null group is a group.  Books of up to `groups` groups are counted first and
    broadcast; of more, payloads are shuffled by group and a hash of the content, so that a large group is many keys.
    """
    books = _slots(code_books(byte_frequencies(df, group, content, order), group), group).persist()  # one row a group
    if books.count() <= groups:  # payloads stay where they are
        joined = df.join(F.broadcast(books), df[group].eqNullSafe(books["_group"]), "left").drop("_group")
    else:
        dealt = df.withColumn("_salt", F.pmod(F.xxhash64(content), F.lit(SALTS)))
        books = books.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = dealt.join(books, df[group].eqNullSafe(books["_group"]) & (F.col("_salt") == F.col("_deal")), "left").drop("_group", "_salt", "_deal")
    joined = joined.withColumn("_e", _encoded(F.col(content), F.col("_codes")))
    table = F.when(F.length(content) > 0, F.col("table")).otherwise(F.expr("map()").cast("map<string,string>"))
    return joined.withColumn("dna", F.col("_e.dna")).withColumn("padding", F.col("_e.padding")).withColumn("table", table).drop("_e", "_codes")


class _Book:
    """A code table by lookup: of the next bits, the byte they begin with and its length; longer codes by name."""

    def __init__(self, table: dict[str, str]):
        self.byte, self.length = np.zeros(1 << LOOKUP, np.uint8), np.zeros(1 << LOOKUP, np.uint8)
        self.long: dict[str, int] = {}
        named = {code: int(byte) for byte, code in table.items() if re.fullmatch("[01]+", code or "")}
        if len(named) < len(table) or any(not 0 <= b <= 255 for b in named.values()):
            raise ValueError("bad code table")
        for code, byte in sorted(named.items(), key=lambda e: -len(e[0])):  # where one code begins another, the shorter holds
            if len(code) > LOOKUP:
                self.long[code] = byte
                continue
            at = int(code, 2) << LOOKUP - len(code)
            span = slice(at, at + (1 << LOOKUP - len(code)))
            self.byte[span], self.length[span] = byte, len(code)
        self.longest = max(map(len, self.long), default=0)

    def ahead(self, bits: np.ndarray) -> np.ndarray:
        """At each place the number that the next LOOKUP bits are."""
        whole = np.concatenate([np.packbits(bits), np.zeros(2, np.uint8)]).astype(np.uint32)
        three = whole[:-2] << 16 | whole[1:-1] << 8 | whole[2:]  # 24 bits from each eighth place on
        shifts = np.arange(24 - LOOKUP, 16 - LOOKUP, -1, dtype=np.uint32)
        return (three[:, None] >> shifts & np.uint32((1 << LOOKUP) - 1)).astype(np.uint16).ravel()[: len(bits)]

    def long_at(self, bits: np.ndarray, p: int) -> str | None:
        """The code of more than LOOKUP bits that stands at a place."""
        code = "".join(map(str, bits[p : p + self.longest]))
        return next((code[:k] for k in range(LOOKUP + 1, len(code) + 1) if code[:k] in self.long), None)

    def span(self, bits: np.ndarray, ahead: np.ndarray, start: int, past: int) -> tuple[bytes, int] | None:
        """(bytes of the codes that begin from start on and before past, where the last one ends); None where no code fits."""
        steps = self.length[ahead[:past]].tobytes()
        places, others, p = [], {}, start
        while p < past:
            step = steps[p]
            if not step:
                fit = self.long_at(bits, p)
                if fit is None:
                    return None
                others[len(places)], step = self.long[fit], len(fit)
            places.append(p)
            p += step
        out = self.byte[ahead[places]] if places else np.zeros(0, np.uint8)
        for i, byte in others.items():
            out[i] = byte
        return out.tobytes(), p

    def walk(self, bits: np.ndarray) -> bytes | None:
        """Bytes of all codes from the first bit to the last; None where bits are left over."""
        found = self.span(bits, self.ahead(bits), 0, len(bits))
        return found[0] if found and found[1] == len(bits) else None

    def exits(self, bits: np.ndarray, past: int, entries: int) -> list[int]:
        """For each of the first places, how far beyond `past` the walk from there ends; -1 where no code fits.

        Walks that meet go on as one, so all of them cost little more than the first.
        """
        ahead = self.ahead(bits)
        steps, end, out = self.length[ahead].tobytes(), {}, []
        for entry in range(entries):
            p, path = entry, []
            while p < past and p not in end:
                path.append(p)
                step = steps[p] or len(self.long_at(bits, p) or "")
                if not step:
                    p = -1
                    break
                p += step
            last = end[p] if p in end else p - past if p >= 0 else -1
            last = last if p in end or p < 0 or p <= len(bits) else -1
            end.update(dict.fromkeys(path, last))
            out.append(last)
        return out


@lru_cache(64)
def _book(entries: tuple[tuple[str, str], ...]) -> _Book:
    return _Book(dict(entries))


_BITS_OF = np.full(256, 4, np.uint8)
_BITS_OF[_LETTERS] = range(4)


def _walk(dna: str | None, table: tuple[tuple[str, str], ...] | None, padding: int | None) -> tuple[bytes | None, str | None]:
    """Payload and error of one sequence."""
    if dna is None:
        return None, None
    pairs = _BITS_OF[np.frombuffer(dna.encode(), np.uint8)]
    if pairs.max(initial=0) > 3:
        return None, "invalid nucleotide"
    bits, padding = np.stack([pairs >> 1, pairs & 1], axis=1).ravel(), padding or 0
    if not 0 <= padding <= min(1, len(bits)):
        return None, "padding is not 0 or 1 bit of the sequence"
    if padding and bits[-1]:
        return None, "padding bits are not zero"
    bits = bits[: len(bits) - padding]
    if not len(bits):
        return (None, "a code table without a sequence") if table else (b"", None)
    if not table:
        return None, "no code table"
    try:
        content = _book(table).walk(bits)
    except ValueError:
        return None, "bad code table"
    return (content, None) if content is not None else (None, "bits are left over")


def _entries(table: pa.Array) -> Iterator[tuple[tuple[str, str], ...] | None]:
    """The entries of each row's table, or None; those that a few rows before had are not made again."""
    known: list[tuple[pa.Scalar, tuple]] = []
    for t in table:
        if not t.is_valid:
            yield None
            continue
        found = next((entries for other, entries in known if other.equals(t)), None)
        if found is None:
            found = tuple(t.as_py())
            known = [(t, found), *known[:7]]
        yield found


def decoded(dna: pa.Array, table: pa.Array, padding: pa.Array) -> pa.Array:
    """(content, error) of a batch; what can't be decoded has an error and no content, a null sequence neither."""
    out = [_walk(d.as_py(), t, p) for d, t, p in zip(dna, _entries(table), padding.to_pylist())]
    return pa.StructArray.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([e for _, e in out], pa.string())], ["content", "error"])


def decode(df: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, dna, table, padding) to (id, content, error)."""
    kind = df.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.sliced(batch, "dna"):
                d = decoded(part.column("dna"), part.column("table"), part.column("padding"))
                yield pa.RecordBatch.from_arrays([part.column("_id"), d.field("content"), d.field("error")], [id_col, "content", "error"])

    return df.select(F.col(id_col).alias("_id"), "dna", "table", "padding").mapInArrow(rows, f"{id_col} {kind}, content binary, error string")


#: The longest code of 256 bytes has 255 bits; so many nucleotides beyond a piece may belong to its last code.
ENTRIES, HALO = 256, 128


def _bits(dna: str) -> np.ndarray | None:
    pairs = _BITS_OF[np.frombuffer(dna.encode(), np.uint8)]
    return None if pairs.max(initial=0) > 3 else np.stack([pairs >> 1, pairs & 1], axis=1).ravel()


def _piece_bits(row: dict) -> tuple[np.ndarray, int] | str:
    """(bits of a piece and its halo, how many are the piece's own), without the padding, or why there are none."""
    bits = _bits(row["text"] + row["tail"])
    if bits is None:
        return "invalid nucleotide"
    padding, total = row["padding"] or 0, row["total"] - row["start"]  # nucleotides from here to the end
    if not 0 <= padding <= 1:
        return "padding is not 0 or 1 bit of the sequence"
    if len(bits) == 2 * total and padding:
        if bits[-1]:
            return "padding bits are not zero"
        bits = bits[:-1]
    return bits, min(2 * row["length"], len(bits))


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[dict]]:
    """The rows of parts of batches, with their tables as tuples."""
    for batch in batches:
        for part in flat.sliced(batch, "text"):
            rest = part.drop_columns(["table"]).to_pylist()
            yield (row | {"table": entries} for row, entries in zip(rest, _entries(part.column("table"))))


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, at, exits ARRAY<INT>, why): a piece's way out from each place where it may be entered."""
    for some in _piece_rows(batches):
        out = []
        for row in some:
            found = _piece_bits(row)
            try:
                if isinstance(found, str):
                    out.append((row["key"], row["at"], None, found))
                elif not row["table"]:
                    out.append((row["key"], row["at"], None, "no code table"))
                else:
                    out.append((row["key"], row["at"], _book(row["table"]).exits(*found, ENTRIES if row["at"] else 1), None))
            except ValueError:
                out.append((row["key"], row["at"], None, "bad code table"))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.string()))], ["key", "at", "exits", "why"])


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _entered(exits: pa.Array) -> pa.Array:
    """Where each piece of a payload is entered, from the ways of all in order, and where the last one is left."""
    out = []
    for ways in exits.to_pylist():
        places = [0]
        for way in ways:
            p = places[-1]
            places.append(-1 if way is None or not 0 <= p < len(way) else way[p])
        out.append(places)
    return pa.array(out, pa.list_(pa.int32()))


def _spelled_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, at, content): the bytes whose codes begin in a piece."""
    for some in _piece_rows(batches):
        out = []
        for row in some:
            bits, own = _piece_bits(row)
            book = _book(row["table"])
            out.append((row["key"], row["at"], book.span(bits, book.ahead(bits), row["entry"], own)[0]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int32(), pa.binary()))], ["key", "at", "content"])


def decode_pieces(parts: DataFrame, books: DataFrame, id_col: str = "id", piece: str = "piece", seq: str = "dna") -> DataFrame:
    """(id, at INT, content, error) of sequences in pieces (id, piece, dna), with (id, table, padding) of each, one row an id.

    A payload is decoded by as many tasks as it has pieces: each follows the codes from every bit at which it may be entered,
    since where the piece before ends is not known yet; walks that meet are one, as prefix codes fall into step.  The ways through
    all pieces of a payload, some hundred numbers each, are then put together, and a second pass spells out the bytes, those of
    a piece in one row, in order of `at`.  A payload that can't be decoded has one row with an error; one without a sequence has
    none.
    """
    spark = parts.sparkSession
    where = shared(spark, "codes")  # read by several passes, and row numbers stay
    keyed = parts.select(F.col(id_col), F.col(piece).alias("piece"), F.col(seq).alias("text"))
    keyed.write.parquet(f"{where}/parts")
    keyed = spark.read.schema(keyed.schema).parquet(f"{where}/parts")
    haloed = pieces.with_halo(keyed, id_col, "piece", "text", HALO)
    sizes = pieces.placed(keyed, id_col, "piece", "text").groupBy(F.col(id_col).alias("_id")).agg(F.sum("length").alias("total"))
    about = sizes.join(books.select(F.col(id_col).alias("_book"), "table", "padding"), F.col("_id").eqNullSafe(F.col("_book")), "left").drop("_book")
    about = about.withColumn("key", F.monotonically_increasing_id())
    about.write.parquet(f"{where}/about")
    about = spark.read.schema(about.schema).parquet(f"{where}/about")
    side = F.broadcast(about) if about.count() <= GROUPS else about
    haloed.join(side, F.col(id_col).eqNullSafe(F.col("_id"))).select("key", "at", "start", "length", "text", "tail", "total", "table", "padding").write.parquet(f"{where}/pieces")
    rows = spark.read.parquet(f"{where}/pieces")
    ways = rows.mapInArrow(_followed, "key long, at int, exits array<int>, why string")
    gathered = ways.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "exits"))).alias("ways"), F.first("why", ignorenulls=True).alias("why"))
    entered = gathered.select("key", _entered(F.col("ways.exits")).alias("places"), "why")
    entered = entered.withColumn("error", F.coalesce("why", F.when(F.element_at("places", -1) != 0, "bits are left over")))
    entered.select("key", "places", "error").write.parquet(f"{where}/entered")
    entered = spark.read.schema("key long, places array<int>, error string").parquet(f"{where}/entered")
    good = entered.where("error is null").select(F.col("key").alias("_key"), F.posexplode(F.slice("places", F.lit(1), F.size("places") - 1)).alias("_at", "entry"))
    spelled = rows.join(good, (F.col("key") == F.col("_key")) & (F.col("at") == F.col("_at"))).drop("_key", "_at").mapInArrow(_spelled_out, "key long, at int, content binary")
    bad = entered.where("error is not null").select("key", F.lit(0).alias("at"), F.lit(None).cast("binary").alias("content"), "error")
    out = spelled.withColumn("error", F.lit(None).cast("string")).unionByName(bad)
    return out.join(about.select(F.col("key").alias("_key"), F.col("_id").alias(id_col)), F.col("key") == F.col("_key")).select(id_col, "at", "content", "error")
