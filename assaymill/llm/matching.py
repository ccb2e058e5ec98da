"""Matching entities across sources without keys.

1. Records of both sources are reduced to attribute values: names (all spellings and synonyms), catalogue numbers, accessions, tissue. Words behind a name that
   are no part of it are learned from the names themselves: a word that mostly stands behind the whole name of some line is an affix. Values consist of tokens:
   character bigrams and counted characters, tagged with the attribute and hashed to ``VOCABULARY`` ids, so that the vocabulary is bounded by construction.
2. Random walks over the record-attribute-token graph start at every record; a walk leaves a token for one of ``RESERVOIR``
   records that hold it, drawn by a seeded hash. Skip-gram vectors with negative sampling are trained on the walks in every partition
   from common starting weights, and averaged by token; two rounds. A value's vector is the sum of its tokens' vectors by rarity.
3. Blocks: names by several tables of hyperplane signs with probes of the least certain signs, whose number grows with the number
   of values; identifiers by one table of many signs (equal values have equal signs). Hashing works on distinct values, so a value shared by any
   number of records is hashed once.
4. Candidates are reranked exactly: per attribute the cosine of the values' vectors and whether they are equal or one edit apart give a level of agreement.
5. The levels are calibrated: a mixture of four latent classes (the same line, namesakes and derived lines, wrong identifiers, unrelated) is fitted by
   expectation-maximisation to the counts of all candidate pairs' patterns of levels and affixes. The probability of the first class is the confidence; it decides.
   No weight is set by hand.

Defined cases: missing values, blanks and placeholders are no evidence; records without any usable value match nothing; exact repeats count
once; several rows of one record are merged; a record gets its best line, ties to the smaller id; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from assaymill.functions.ids import PLACEHOLDERS, strict_id, trimmed
from assaymill.session import settle

VOCABULARY = 1 << 14
DIM = 128
RESERVOIR = 16
WALKS, LENGTH = 4, 6
STEP = 128  #: records per gradient step
NAME_TABLES, PROBES = 24, 4
ID_BITS = 60
BUCKET = 4096  #: stored or asking values of a bucket met in one task
SHARED = 64  #: lines sharing a value beyond which they are joined in blocks of this size
#: Edges of the cosine levels of near and of different values; equal values are the tenth level.
NEAR_COSINES, FAR_COSINES, LEVELS = (0.7, 0.8, 0.9), (0.5, 0.6, 0.7, 0.8), 10
PRIOR = 4.0  #: pairs that a class's starting idea of an attribute counts for
AFFIX_SHARE, AFFIX_LEAST, AFFIX_TAILS = 0.002, 3, 0.5



def plain(s: str | None) -> str:
    return re.sub(r"[^A-Z0-9]", "", (s or "").upper())


WORD = re.compile(r"[^\W\d_]+\d*|\d+")


def words(s: str | None) -> list[str]:
    """Words of a name: letters with the digits behind them, or digits; none for a placeholder."""
    return [] if not s or s.strip().upper() in PLACEHOLDERS else WORD.findall(s.upper())


def shape(word: str) -> str:
    return re.sub(r"\d+", "#", word)


def split_name(ws: list[str], affixes: frozenset[str] | set[str]) -> tuple[str, list[str]]:
    """Bare name and the affixes behind it."""
    at = next((i for i in range(1, len(ws)) if shape(ws[i]) in affixes), len(ws))
    return plain("".join(ws[:at])), sorted({shape(w) for w in ws[at:] if shape(w) in affixes})


def number_value(s: str | None) -> str:
    s = re.sub(r"\.0+$", "", (s or "").strip().upper().replace("COSMIC", "").strip(" :"))
    return s.lstrip("0") if s.isdigit() else ""


def accession_value(s: str | None) -> str:
    s = plain(s)
    return "" if (s or "") in PLACEHOLDERS else re.sub(r"^(RRID)?(CVCL)?", "", s)


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, names, number, accession, tissue) of raw attribute columns: names as their words joined by blanks."""
    for b in batches:
        out: list[list] = [[] for _ in range(5)]
        for rid, names, number, accession, tissue in zip(*(b.column(i).to_pylist() for i in range(5))):
            spelled = sorted({" ".join(w) for n in names or [] for x in re.split(r"[;,|]", n or "") if (w := words(x))})
            if number and "CVCL" in number.upper():  # an accession in the wrong column
                number, accession = "", accession or number
            if accession and accession.upper().startswith("COSMIC"):
                number, accession = number or accession, ""
            v = number_value(number), accession_value(accession), plain(tissue)
            for col, x in zip(out, (rid, spelled, *[[x] if x and x not in PLACEHOLDERS else [] for x in v])):
                col.append(x)
        kinds = [pa.string(), *[pa.list_(pa.string())] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["rid", "names", "number", "accession", "tissue"])


def spelled_records(rows: DataFrame, side: str, rid, names: list[str], number: str, accession: str, tissue: str) -> DataFrame:
    """One row per record: side, rid and the sorted distinct values of each attribute; names are spelled out with their affixes."""
    src = rows.select(rid.alias("rid"), F.array(*[F.col(n) for n in names]).alias("names"), number, accession, tissue).filter("rid IS NOT NULL").distinct()
    parsed = src.mapInArrow(_spelled, "rid string, names array<string>, number array<string>, accession array<string>, tissue array<string>")
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return parsed.groupBy("rid").agg(*[merged(c) for c in ("names", "number", "accession", "tissue")]).withColumn("side", F.lit(side))


def learned_affixes(recs: DataFrame) -> list[str]:
    """Shapes of words that are no part of a name: most names that have one are, up to some word before it, the whole name of a line.

    Only shapes in at least AFFIX_SHARE of the names (and AFFIX_LEAST of them) are considered, so at most some hundreds, whatever the number of records.
    """
    names = recs.select("side", F.explode("names").alias("n")).distinct()
    ws = F.split("n", " ")
    whole = names.filter("side = 'L'").select(F.regexp_replace("n", " ", "").alias("core")).distinct()
    heads = names.select("n", ws.alias("ws")).filter(F.size("ws") > 1).distinct().select("n", "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("i"))
    known = heads.withColumn("core", F.array_join(F.slice("ws", F.lit(1), F.col("i")), "")).join(whole, "core", "left_semi").groupBy("n").agg(F.min("i").alias("head"))
    at = names.select("n", ws.alias("ws")).distinct().join(known, "n", "left").select(F.posexplode("ws").alias("i", "w"), "head").filter("i > 0")
    per = at.groupBy(F.regexp_replace("w", r"\d+", "#").alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("i") >= F.col("head")).alias("tails"))
    n = names.count()
    found = per.filter((F.col("n") >= max(AFFIX_LEAST, AFFIX_SHARE * n)) & (F.col("tails") >= AFFIX_TAILS * F.col("n")) & F.col("shape").rlike("[^#]"))
    return sorted(r["shape"] for r in found.select("shape").collect())


def bare_records(spelled: DataFrame, affixes: list[str]) -> DataFrame:
    """Records with bare names and the affixes met in any of their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozenset(affixes)
        for b in batches:
            split = [[split_name(n.split(" "), known) for n in ns] for ns in b.column("names").to_pylist()]
            # a name with affixes is kept whole as well, as what looks like an affix may be a part of it
            name = pa.array([sorted({v for n, (bare, _) in zip(ns, x) for v in (bare, plain(n)) if v}) for ns, x in zip(b.column("names").to_pylist(), split)], pa.list_(pa.string()))
            affix = pa.array([sorted({a for _, t in x for a in t}) for x in split], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("rid"), name, affix, *[b.column(c) for c in ("number", "accession", "tissue", "side")]], ["rid", "name", "affix", "number", "accession", "tissue", "side"])

    return spelled.select("rid", "names", "number", "accession", "tissue", "side").mapInArrow(run, "rid string, name array<string>, affix array<string>, number array<string>, accession array<string>, tissue array<string>, side string")


def tokens(attribute: str, value: str) -> list[int]:
    """Vocabulary ids of a value's bigrams and counted characters, which misspellings leave mostly intact."""
    s = f"^{value}$"
    grams = [s[i : i + 2] for i in range(len(s) - 1)] + [f"{c}{value[:i].count(c)}" for i, c in enumerate(value[:64])]
    return [xxhash.xxh32_intdigest(f"{attribute}:{g}") % VOCABULARY for g in grams]


def parts(df: DataFrame) -> int:
    """Tasks for Python work on a small table, which adaptive coalescing would put into one."""
    return max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


ATTRIBUTES = ("name", "number", "accession", "tissue")


def _record_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(a).to_pylist() for a in ATTRIBUTES]
        ts = [[t for a, vs in zip(ATTRIBUTES, row) for v in vs for t in tokens(a, v)] for row in zip(*cols)]
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(ts, pa.list_(pa.int32()))], ["key", "ts"])


def start_vectors(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((VOCABULARY, DIM)).astype(np.float32) / math.sqrt(DIM)


def _walks(rng: np.random.Generator, starts: list[list[int]], res: tuple[np.ndarray, ...]) -> np.ndarray:
    """WALKS walks of LENGTH tokens from every record: token, a record that holds it, one of its tokens, and so on."""
    flat, entry, offsets = res  # tokens of the drawn records, where each record's begin, where each token's records begin
    own = np.array([t for ts in starts for t in ts], np.int64)
    sizes = np.array([len(ts) for ts in starts])
    lo = np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), WALKS)
    size = np.repeat(sizes, WALKS)
    out = np.empty((len(lo), LENGTH), np.int64)
    out[:, 0] = t = own[lo + (rng.random(len(lo)) * size).astype(np.int64)]
    for k in range(1, LENGTH):
        n = offsets[t + 1] - offsets[t]
        e = offsets[t] + (rng.random(len(t)) * n).astype(np.int64)
        width = entry[e + 1] - entry[e]
        out[:, k] = t = flat[entry[e] + (rng.random(len(t)) * width).astype(np.int64)]
    return out


def _skip_gram(shared, rate: float, seed: int):
    """Train on the walks that start in this partition; yields the weights of the tokens met, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vin, vout, res, noise = shared.value
        vin, vout = vin.copy(), vout.copy()
        met = np.zeros(VOCABULARY, np.int64)
        for b in batches:
            keys, lists = b.column("key").to_pylist(), b.column("ts").to_pylist()
            for at in range(0, len(keys), STEP):
                starts = [ts for ts in lists[at : at + STEP] if ts]
                if not starts:
                    continue
                rng = np.random.default_rng(xxhash.xxh64_intdigest(keys[at], seed))
                walks = _walks(rng, starts, res)
                c = np.concatenate([walks[:, :-g].ravel() for g in (1, 2)])
                o = np.concatenate([walks[:, g:].ravel() for g in (1, 2)])
                target = np.concatenate([o[:, None], noise[rng.integers(len(noise), size=(len(c), 3))]], 1)
                x, y = vin[c], vout[target]
                p = 1 / (1 + np.exp(-np.einsum("nd,nkd->nk", x, y)))
                p[:, 0] -= 1
                p = (p * rate).astype(np.float32)
                _descend(vin, c, np.einsum("nk,nkd->nd", p, y))
                _descend(vout, target.ravel(), (p[:, :, None] * x[:, None, :]).reshape(-1, DIM))
                np.add.at(met, c, 1)
        ids = np.flatnonzero(met)
        flat = np.concatenate([vin[ids], vout[ids]], 1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * 2 * DIM, pa.int32()), pa.array(flat.ravel(), pa.float32()))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(met[ids], pa.int64()), lists], ["t", "n", "v"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights per token, averaged over the partitions by how often each met the token; a token lies in one partition here."""
    total: dict[int, np.ndarray] = {}
    met: dict[int, int] = {}
    for b in batches:
        v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * DIM)
        for t, n, row in zip(b.column("t").to_pylist(), b.column("n").to_pylist(), v):
            total[t] = total.get(t, 0) + n * row.astype(np.float64)
            met[t] = met.get(t, 0) + n
    vecs = [(total[t] / met[t]).astype(np.float32).tobytes() for t in total]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(vecs, pa.binary())], ["t", "v"])


def _descend(w: np.ndarray, ids: np.ndarray, g: np.ndarray) -> None:
    """Subtract the summed gradients of each row, no row moving by more than a unit step."""
    order = np.argsort(ids, kind="stable")
    rows, first = np.unique(ids[order], return_index=True)
    step = np.add.reduceat(g[order], first, axis=0)
    long = np.linalg.norm(step, axis=1, keepdims=True)
    w[rows] -= step / np.maximum(long, 1)


def token_vectors(recs: DataFrame, seed: int = 5, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, rarity) of the vocabulary; what reaches the driver is bounded by VOCABULARY and RESERVOIR."""
    spark = recs.sparkSession
    keyed = recs.select(F.concat("side", F.lit(":"), "rid").alias("key"), *ATTRIBUTES).repartition(parts(recs), "key").sortWithinPartitions("key")
    toks = settle(keyed.mapInArrow(_record_tokens, "key string, ts array<int>"))
    per = toks.select("key", "ts", F.explode(F.array_distinct("ts")).alias("t"))
    df = np.zeros(VOCABULARY)
    for r in per.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():
        df[r["t"]] = r["n"]
    n = toks.count()
    w = Window.partitionBy("t").orderBy("h", "key")
    drawn = per.withColumn("h", F.xxhash64(F.lit(seed), "key", "t")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= RESERVOIR).select("t", F.array_distinct("ts").alias("ts"))
    lists: list[list] = [[] for _ in range(VOCABULARY)]
    for r in drawn.toLocalIterator():
        lists[r["t"]].append(np.array(r["ts"], np.int32))
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    drawn_records = [x for part in lists for x in part]
    entry = np.concatenate([[0], np.cumsum([len(x) for x in drawn_records])]).astype(np.int64)
    flat = np.concatenate(drawn_records) if drawn_records else np.zeros(0, np.int32)
    weights = df**0.75
    noise = np.random.default_rng(seed).choice(VOCABULARY, 100_000, p=weights / weights.sum()) if weights.sum() else np.zeros(1, np.int64)
    vin, vout = start_vectors(seed), np.zeros((VOCABULARY, DIM), np.float32)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((vin, vout, (flat, entry, offsets), noise))
        trained = toks.mapInArrow(_skip_gram(shared, 0.05, seed + k), "t int, n bigint, v array<float>")
        for r in trained.repartition(parts(recs), "t").mapInArrow(_average, "t int, v binary").collect():  # at most VOCABULARY rows
            vin[r["t"]], vout[r["t"]] = np.frombuffer(r["v"], np.float32).reshape(2, DIM)
        shared.unpersist()
    vin -= (df @ vin / max(df.sum(), 1)).astype(np.float32)  # what all tokens have in common tells no values apart
    return vin, np.sqrt(np.log((n + 1) / (df + 1)) + 0.5).astype(np.float32)


def value_vector(attribute: str, value: str, vectors: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    t = tokens(attribute, value)
    v = rarity[t] @ vectors[t]
    return v / max(float(np.linalg.norm(v)), 1e-12)


KINDS = ("name", "number", "accession")
BAG = 37  #: classes of characters counted per value


def _bag(value: str) -> np.ndarray:
    return np.minimum(np.bincount(np.frombuffer(value.encode(), np.uint8) % BAG, minlength=BAG), 255).astype(np.uint8)


def _hash_values(shared, bits: int):
    """A row per value with its codes; asking sides also get probes that flip their least certain signs. ``sig``: all signs of a name, then its character counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, rarity = shared.value
        planes = np.random.default_rng(99).standard_normal((DIM, NAME_TABLES * bits)).astype(np.float32)
        wide = np.random.default_rng(98).standard_normal((DIM, ID_BITS)).astype(np.float32)
        base = np.arange(NAME_TABLES, dtype=np.int64) << 40
        for b in batches:
            if not b.num_rows:
                continue
            attribute, value = b.column("attribute").to_pylist(), b.column("value").to_pylist()
            kind = np.array([KINDS.index(a) for a in attribute], np.int32)
            asks, stored = (b.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "stored"))
            v = np.stack([value_vector(a, x, vectors, rarity) for a, x in zip(attribute, value)])
            names, rest = np.flatnonzero(kind == 0), np.flatnonzero(kind != 0)
            y = (v[names] @ planes).reshape(len(names), NAME_TABLES, bits)
            code = (y > 0) @ (1 << np.arange(bits, dtype=np.int64)) + base
            sig = [b""] * len(value)
            signs = np.packbits((y > 0).reshape(len(names), NAME_TABLES * bits), axis=1)
            for k, i in enumerate(names):
                sig[i] = signs[k].tobytes() + _bag(value[i]).tobytes()
            q = np.flatnonzero(asks[names])
            sure = np.argsort(np.abs(y[q]), axis=2)[:, :, :PROBES]
            probe = code[q][:, :, None] ^ (np.int64(1) << sure)
            own: list[np.ndarray] = [np.zeros(0, np.int64)] * len(value)
            flips = own.copy()
            for k, i in enumerate(names):
                own[i] = code[k]
            for k, i in enumerate(names[q]):
                flips[i] = probe[k].ravel()
            for i, c in zip(rest, (v[rest] @ wide > 0) @ (1 << np.arange(ID_BITS, dtype=np.int64))):
                own[i] = np.array([c])
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32)), pa.array(np.concatenate(xs), pa.int64())) for xs in (own, flips)]
            yield pa.RecordBatch.from_arrays([pa.array(kind), b.column("value"), pa.array(stored), pa.array(asks), pa.array(sig, pa.binary()), *lists], ["kind", "value", "stored", "asks", "sig", "own", "flips"])

    return run


def _bucket_pairs(least: float, bits: int):
    """Value pairs of a bundle of buckets whose signs agree enough and which can be near names; equal values always do."""
    width = -(-NAME_TABLES * bits // 8)

    def run(table: pa.Table) -> pa.Table:
        kind, code, cell, stored, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "code", "cell", "stored", "asks"))
        named = np.flatnonzero(kind == 0)
        place = np.zeros(len(kind), np.int64)
        place[named] = np.arange(len(named))
        flat = np.frombuffer(b"".join(table.column("sig").take(pa.array(named)).to_pylist()), np.uint8).reshape(len(named), width + BAG)
        order = np.lexsort((cell, kind, code))
        cuts = np.flatnonzero((np.diff(code[order]) != 0) | (np.diff(kind[order]) != 0) | (np.diff(cell[order]) != 0)) + 1
        asked, known = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for run_ in np.split(order, cuts) if len(order) else []:
            s, q = run_[stored[run_]], run_[asks[run_]]
            if not len(s) or not len(q):
                continue
            if kind[run_[0]] != 0:
                asked.append(np.repeat(q, len(s)))
                known.append(np.tile(s, len(q)))
                continue
            a = flat[place[s]]
            for lo in range(0, len(q), 256):
                part = q[lo : lo + 256]
                c = flat[place[part]]
                # one edit changes at most two character counts, so farther bags cannot be near names
                apart = np.abs(c[:, None, width:].astype(np.int16) - a[None, :, width:]).sum(2)
                i, j = np.nonzero(apart <= 2)
                differ = np.bitwise_count(c[i, :width] ^ a[j, :width]).sum(1, dtype=np.int32) / (NAME_TABLES * bits)
                ok = np.cos(np.pi * differ) >= least
                asked.append(part[i[ok]])
                known.append(s[j[ok]])
        i, j = (pa.array(np.concatenate(x)) for x in (asked, known))
        names = pa.array(KINDS).take(table.column("kind").take(i).combine_chunks())
        return pa.table({"attribute": names, "pvalue": table.column("value").take(i), "lvalue": table.column("value").take(j)})

    return run


def value_pairs(recs: DataFrame, vectors: np.ndarray, rarity: np.ndarray, least: float = 0.55) -> DataFrame:
    """(attribute, pvalue, lvalue) that share a bucket and are similar by their signs."""
    spark = recs.sparkSession
    shared = spark.sparkContext.broadcast((vectors, rarity))
    each = None
    for a in ("name", "number", "accession"):
        part = recs.select("side", F.lit(a).alias("attribute"), F.explode(a).alias("value"))
        each = part if each is None else each.unionByName(part)
    values = settle(each.groupBy("attribute", "value").agg(F.max(F.col("side") == "P").alias("asks"), F.max(F.col("side") == "L").alias("stored")))
    n = values.filter("attribute = 'name' AND stored").count()
    bits = max(4, min(30, math.ceil(math.log2(max(n, 1) / 8 + 1))))
    coded = settle(values.repartition(parts(recs), "attribute", "value").mapInArrow(_hash_values(shared, bits), "kind int, value string, stored boolean, asks boolean, sig binary, own array<bigint>, flips array<bigint>"))
    visit = lambda c, stored, asks: F.struct(c.alias("code"), stored.alias("stored"), asks.alias("asks"))
    visits = F.concat(F.transform("own", lambda c: visit(c, F.col("stored"), F.col("asks"))), F.transform("flips", lambda c: visit(c, F.lit(False), F.lit(True))))
    rows = coded.select("kind", "value", "sig", F.explode(visits).alias("x")).select("kind", "value", "sig", "x.*")
    # a bucket of more than BUCKET values is met in pairs of blocks of its asking and its stored values, in separate tasks
    sizes = rows.select("kind", "code", "stored", "asks").groupBy("kind", "code").agg(F.count_if("stored").alias("s"), F.count_if("asks").alias("a"))
    big = settle(sizes.filter(F.greatest("s", "a") > BUCKET).select("kind", "code", F.ceil(F.col("s") / BUCKET).cast("int").alias("sb"), F.ceil(F.col("a") / BUCKET).cast("int").alias("ab")))
    n_big = big.count()
    if n_big:
        rows = rows.join(F.broadcast(big) if n_big <= 100_000 else big, ["kind", "code"], "left")
        place = lambda n, of: F.pmod(F.xxhash64(F.lit(of), "value"), F.greatest(F.col(n), F.lit(1)))
        every = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
        piece = lambda cell, stored, asks: F.struct(cell.cast("bigint").alias("cell"), stored.alias("stored"), asks.alias("asks"))
        no, yes = F.lit(False), F.lit(True)
        as_stored = F.when(F.col("stored"), F.transform(every("ab"), lambda i: piece(i * F.col("sb") + place("sb", "s"), yes, no)))
        as_asking = F.when(F.col("asks"), F.transform(every("sb"), lambda j: piece(place("ab", "a") * F.col("sb") + j, no, yes)))
        none = F.array().cast("array<struct<cell: bigint, stored: boolean, asks: boolean>>")
        pieces = F.when(F.col("sb").isNull(), F.array(piece(F.lit(0), F.col("stored"), F.col("asks")))).otherwise(F.concat(F.coalesce(as_stored, none), F.coalesce(as_asking, none)))
        rows = rows.select("kind", "value", "sig", "code", F.explode(pieces).alias("p")).select("kind", "value", "sig", "code", "p.*")
    else:
        rows = rows.withColumn("cell", F.lit(0).cast("bigint"))
    bundles = max(1, values.count() * NAME_TABLES // 4000)
    met = rows.groupBy(F.pmod(F.xxhash64("kind", "code", "cell"), F.lit(bundles)).alias("bundle")).applyInArrow(_bucket_pairs(least, bits), "attribute string, pvalue string, lvalue string")
    return met.distinct()


def edits(a: str, b: str, most: int = 2) -> int:
    """Damerau-Levenshtein distance (adjacent transpositions), capped at most + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], two[j - 2] + 1)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def agreement(a: list[str], b: list[str], near: int = 1) -> int | None:
    """2 equal, 1 near, 0 conflicting, None when either side has no value."""
    if not a or not b:
        return None
    if not set(a).isdisjoint(b):
        return 2
    return 1 if min(edits(x, y, near) for x in a for y in b) <= near else 0


def level(grade: int | None, cosine: float) -> int:
    """Level of agreement: -1 for a missing value, different values by cosine (0-4), near ones by cosine (5-8), equal ones (9)."""
    if grade is None:
        return -1
    return 9 if grade == 2 else 5 + int(np.searchsorted(NEAR_COSINES, cosine)) if grade == 1 else int(np.searchsorted(FAR_COSINES, cosine))


def _rerank(shared):
    """Exact comparison of candidate pairs: cosines and edit grades of each attribute as levels, and the affixes that one side alone has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, rarity = shared.value
        known: dict[tuple[str, str], np.ndarray] = {}

        def vec(a: str, v: str) -> np.ndarray:
            if (a, v) not in known:
                if len(known) > 50_000:
                    known.clear()
                known[a, v] = value_vector(a, v, vectors, rarity)
            return known[a, v]

        def compared(a: str, xs: list[str], ys: list[str]) -> tuple[int | None, float]:
            """Grade and cosine of two lists of values; equal values have cosine 1, so they need no vectors."""
            grade = agreement(xs, ys)
            if grade is None or grade == 2:
                return grade, 1.0
            return grade, max(float(vec(a, x) @ vec(a, y)) for x in xs for y in ys)

        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            sides = [[b.column(f"{s}_{a}").to_pylist() for a in (*ATTRIBUTES, "affix")] for s in "pl"]
            ids = b.column("prid").to_pylist(), b.column("lrid").to_pylist()
            for i in range(b.num_rows):
                seen = [compared(a, sides[0][k][i], sides[1][k][i]) for k, a in enumerate(ATTRIBUTES)]
                cos = [c for g, c in seen if g is not None]
                apart = set(sides[0][-1][i]) ^ set(sides[1][-1][i])
                for col, x in zip(cols, (ids[0][i], ids[1][i], *[level(g, c) for g, c in seen], " ".join(sorted(apart)), round(sum(cos) / len(cos), 9) if cos else 0.0)):
                    col.append(x)
            kinds = [pa.string(), pa.string(), *[pa.int32()] * 4, pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["prid", "lrid", *ATTRIBUTES, "apart", "cosine"])

    return run


def tagged(attribute: str, name: str):
    return lambda x: F.struct(F.lit(attribute).alias("attribute"), x.alias(name))


def candidates(recs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(prid, lrid) of records whose values were paired.

    A value shared by more than SHARED lines is joined in blocks of about as many lines, so that no task holds the whole group.
    Lines of a crowd that are alike in every attribute score alike, and the smallest id wins: it stands for them.
    """
    use = lambda side, r, v: recs.filter(F.col("side") == side).select(
        F.col("rid").alias(r), F.explode(F.concat(*[F.transform(a, tagged(a, v)) for a in ("name", "number", "accession")])).alias("x")
    ).select(r, "x.*")
    lines, asked = use("L", "lrid", "lvalue"), use("P", "prid", "pvalue")
    value = ["attribute", "lvalue"]
    crowd = settle(lines.groupBy(*value).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHARED))
    few = lines.join(crowd, value, "left_anti")
    plain_pairs = pairs.join(few, value).join(asked, ["attribute", "pvalue"]).select("prid", "lrid")
    if not crowd.limit(1).count():
        return plain_pairs.distinct()
    alike = recs.filter("side = 'L'").groupBy(*ATTRIBUTES, "affix").agg(F.min("rid").alias("lrid")).select("lrid")
    many = settle(lines.join(crowd.select(*value), value).join(alike, "lrid", "left_semi"))
    blocks = many.groupBy(*value).agg(F.ceil(F.count(F.lit(1)) / SHARED).cast("int").alias("blocks"))
    stored = many.join(blocks, value).select(*value, "lrid", F.pmod(F.xxhash64("lrid"), F.col("blocks")).cast("int").alias("block"))
    met = pairs.join(blocks, value).join(asked, ["attribute", "pvalue"]).select(*value, "prid", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return plain_pairs.unionByName(met.join(stored, [*value, "block"]).select("prid", "lrid")).distinct()


def first_guess(x: np.ndarray) -> np.ndarray:
    """Starting class of each pattern: 0 same line, 1 namesake or derived line, 2 wrong identifier, 3 unrelated."""
    name, ids = x[:, 0], x[:, 1:3]
    low = lambda c: (c >= 0) & (c <= 4)
    conflict = low(ids).any(1)
    same = ((x[:, :3] >= 5).sum(1) + (x[:, 3] == 9) >= 2) & ~low(name) & ~conflict
    sharing = (ids == 9).any(1) & low(name)
    return np.select([same, (name == 9) & conflict, sharing], [0, 1, 2], 3)


def latent_classes(x: np.ndarray, apart: list[str], n: np.ndarray, rounds: int = 300) -> np.ndarray:
    """P(same line) of each pattern of levels (patterns, attributes) seen ``n`` times; expectation-maximisation over four latent classes.

    Within a class the attributes' levels and the affixes set apart are independent; a missing value says nothing. Each class's levels are smoothed by
    the levels of all pairs and, so that a handful of records is judged sensibly too, by PRIOR pairs of the class's starting idea.
    """
    marks: list[np.ndarray] = []
    for a in sorted({a for s in apart for a in s.split(" ") if a}):
        has = np.array([a in s.split(" ") for s in apart])
        if all((n * (has & m)).sum() < 0.5 * (n * (has | m)).sum() for m in marks):  # words that go together, such as two of one phrase, are one mark
            marks.append(has)
    cols = [*x.T, *[m.astype(np.int64) for m in marks]]
    r = np.zeros((len(n), 4))
    r[np.arange(len(n)), first_guess(x)] = 1
    # starting ideas of names, numbers and accessions, by class
    idea = {"same": np.r_[np.full(5, 0.01), np.full(4, 0.05), 0.75], "other": np.r_[np.full(5, 0.19), np.full(4, 0.01), 0.01]}
    hints = [[idea[k] for k in ks] for ks in (("same", "same", "other", "other"), ("same", "other", "same", "other"), ("same", "other", "same", "other"))]
    ll = np.zeros_like(r)
    for _ in range(rounds):
        w = r * n[:, None]
        ll[:] = np.log((w.sum(0) + 1) / (w.sum() + 4))
        for j, c in enumerate(cols):
            there = c >= 0
            size = LEVELS if j < 4 else 2
            t = np.zeros((size, 4))
            np.add.at(t, c[there], w[there])
            if j < 3:
                t += PRIOR * np.stack(hints[j], 1)
            overall = (t.sum(1, keepdims=True) + 0.01) / (t.sum() + 0.01 * size)
            t = (t + 2 * overall) / (t.sum(0) + 2)
            ll[there] += np.log(t[c[there]])
        new = np.exp(ll - ll.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        moved, r = float((np.abs(new - r) * n[:, None]).sum()), new
        if moved < 1e-6 * n.sum():
            break
    return r[:, 0]


def judged(scored: DataFrame) -> DataFrame:
    """scored with ``confidence``: the calibrated probability of its pattern. The driver sees patterns, whose number is bounded by the levels (11 to the third, times
    three) and the sets of affixes met, not pairs."""
    keys = [*ATTRIBUTES, "apart"]
    seen = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(*keys).collect()
    if not seen:
        return scored.withColumn("confidence", F.lit(0.0))
    p = latent_classes(np.array([[r[a] for a in ATTRIBUTES] for r in seen]), [r["apart"] for r in seen], np.array([r["n"] for r in seen], np.float64))
    spark = scored.sparkSession
    table = spark.createDataFrame([(*[r[k] for k in keys], float(x)) for r, x in zip(seen, p)], ", ".join(f"{a} int" for a in ATTRIBUTES) + ", apart string, confidence double")
    return scored.join(F.broadcast(table), keys)


def match(lines: DataFrame, passports: DataFrame, least: float = 0.5) -> DataFrame:
    """(sanger_model_id, model_id, confidence, cosine): each passport record's most probable line, if it is more probable than not."""
    left = spelled_records(lines, "L", strict_id("sanger_model_id"), ["cell_line_name", "gdsc_cell_line_name", "synonyms"], "cosmic_id", "cellosaurus_accession", "oncotree_lineage")
    right = spelled_records(passports, "P", F.nullif(trimmed("model_id"), F.lit("")), ["model_name", "synonyms"], "cosmic_id", "rrid", "tissue")
    spelled = settle(left.unionByName(right))
    recs = settle(bare_records(spelled, learned_affixes(spelled)))
    vectors, rarity = token_vectors(recs)
    pairs = settle(candidates(recs, settle(value_pairs(recs, vectors, rarity))))
    shared = recs.sparkSession.sparkContext.broadcast((vectors, rarity))
    full = lambda side, s: recs.filter(F.col("side") == side).select(F.col("rid").alias(f"{s}rid"), *[F.col(a).alias(f"{s}_{a}") for a in (*ATTRIBUTES, "affix")])
    met = pairs.join(full("P", "p"), "prid").join(full("L", "l"), "lrid").repartition(parts(recs), "prid", "lrid")
    scored = settle(met.mapInArrow(_rerank(shared), "prid string, lrid string, " + ", ".join(f"{a} int" for a in ATTRIBUTES) + ", apart string, cosine double"))
    w = Window.partitionBy("prid").orderBy(F.desc("confidence"), F.desc("cosine"), "lrid")
    top = judged(scored).filter(F.col("confidence") > least).withColumn("r", F.row_number().over(w)).filter("r = 1")
    return top.select(F.col("lrid").alias("sanger_model_id"), F.col("prid").alias("model_id"), F.round("confidence", 4).alias("confidence"), F.round("cosine", 4).alias("cosine"))
