"""MinHash near-duplicates with sequential Bayesian verification.

1. Rows of one word sequence are one class; the rest works on one
   representative of each (its smallest id).
2. Signatures are cut into bands; representatives that agree on a band share
   a bucket. The number of bands follows from the chosen miss probability.
3. Candidates are members of a bucket and its leader, not all pairs. What
   leaders leave apart is then finished exactly: members outside a bucket's
   largest component meet all members of its other components. A pair inside
   one component needs no look.
4. A candidate's signatures are compared in batches. After each batch the
   posterior probability that the similarity reaches the threshold (uniform
   prior) is known from the matches so far; below the miss probability the
   pair is pruned.
5. Survivors are verified on their full shingle sets, exactly.

Links go through components(); a document's component is its smallest id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waywarden.llm.common import discard, documents, written
from waywarden.operators.graph import components

ROWS = 5
BATCH = 20
MISS = 1e-6
#: Rounds of leaders before the rest is finished; each takes another leader.
LEADER_ROUNDS = 3
#: Documents, and their shingles, on each side of a tile of the finish.
TILE, TILE_SHINGLES = 256, 400_000
#: A bucket with more members is spread over SALTS tasks.
HOT, SALTS = 256, 16
BUCKET = ["bucket", "salt"]
WORD_MEMORY = 400_000


@dataclass(frozen=True)
class Rule:
    """Distinct shingles of `words` words; linked at percent * union <= 100 * intersection."""

    words: int = 5
    percent: int = 80
    miss: float = MISS

    @property
    def bands(self) -> int:
        """As many as make a pair at the threshold meet in one but for the miss probability."""
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** ROWS))

    @property
    def hashes(self) -> int:
        return self.bands * ROWS


def least_matches(rule: Rule, batch: int = BATCH) -> list[int]:
    """For each batch's end n: with fewer matches of n, P(similarity >= threshold | matches) < miss.

    Matches m of n under a uniform prior give Beta(m + 1, n - m + 1), whose
    upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    t, out = rule.percent / 100, []
    for n in range(batch, rule.hashes + 1, batch):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= rule.miss:
                break
            m += 1
        out.append(m)
    return out


def shingles(text: str | None, words: int) -> set[bytes]:
    """The distinct shingles as byte strings; a shorter sequence is one shingle."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return set()
    if len(ws) < words:
        return {b" ".join(ws)}
    return set(map(b" ".join, zip(*[ws[i:] for i in range(words)], strict=False)))


def _numbers(count: int, label: bytes) -> np.ndarray:
    return np.frombuffer(b"".join(blake2b(label + i.to_bytes(4, "little"), digest_size=8).digest() for i in range(count)), "<u8")


class _Hasher:
    """64-bit hashes of words, remembered, and signatures of word sequences."""

    def __init__(self, rule: Rule):
        self.rule = rule
        seeds = _numbers(rule.hashes, b"minhash")
        self.xor = (seeds >> np.uint64(32)).astype(np.uint32)[:, None]
        self.mul = (seeds.astype(np.uint32) | np.uint32(1))[:, None]
        self.place = _numbers(rule.words, b"place") | np.uint64(1)
        self.known: dict[bytes, int] = {}

    def word_hashes(self, ws: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > WORD_MEMORY:
            known.clear()
        for w in set(ws).difference(known):
            known[w] = int.from_bytes(blake2b(w, digest_size=8).digest(), "little")
        return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))

    def sets(self, ws: list[bytes]) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles."""
        h, k = self.word_hashes(ws), self.rule.words
        if len(h) < k:
            mixed = np.array([int.from_bytes(blake2b(b" ".join(ws), digest_size=8).digest(), "little")], np.uint64)
        else:
            mixed = np.zeros(len(h) - k + 1, np.uint64)
            for i in range(k):
                mixed = (mixed ^ (mixed >> np.uint64(29))) * self.place[i] + h[i : len(h) - k + 1 + i]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        return np.unique(mixed)

    def signature(self, values: np.ndarray) -> np.ndarray:
        x = (values >> np.uint64(32)).astype(np.uint32)
        best = np.full((self.rule.hashes, 1), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 2048):
            v = (x[None, at : at + 2048] ^ self.xor) * self.mul
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x85EBCA6B)
            best = np.minimum(best, v.min(axis=1, keepdims=True))
        return best[:, 0]


SIGNED = "doc_id long, n_shingles long, key binary, sig binary"


def _sign(rule: Rule):
    def run(batches):
        hasher = _Hasher(rule)
        for b in batches:
            texts = b.column("text")
            for at in range(0, len(texts), 256):
                keys, sizes, sigs = [], [], []
                for text in texts.slice(at, 256).to_pylist():
                    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
                    if not ws:
                        keys.append(None), sizes.append(0), sigs.append(None)
                        continue
                    values = hasher.sets(ws)
                    keys.append(blake2b(b" ".join(ws), digest_size=16).digest())
                    sizes.append(len(values))
                    sigs.append(hasher.signature(values).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, 256), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                    names=["doc_id", "n_shingles", "key", "sig"],
                )

    return run


def _prune(rule: Rule):
    least = least_matches(rule)

    def run(batches):
        for b in batches:
            n = len(b)
            if not n:
                continue
            one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u4").reshape(n, -1) for c in ("sig_a", "sig_b"))
            alive, matches = np.arange(n), np.zeros(n, np.int64)
            for i, most in enumerate(least):
                at = slice(i * BATCH, (i + 1) * BATCH)
                matches = matches + (one[alive, at] == two[alive, at]).sum(axis=1)
                stay = matches >= most
                alive, matches = alive[stay], matches[stay]
            take = pa.array(alive)
            yield pa.RecordBatch.from_arrays([b.column("a").take(take), b.column("b").take(take)], names=["a", "b"])

    return run


def _verify(rule: Rule):
    def run(batches):
        last, last_set = None, set()
        for b in batches:
            linked = []
            texts_a, texts_b, a = b.column("text_a"), b.column("text_b"), b.column("a").to_pylist()
            for i in range(len(b)):
                if a[i] != last:
                    last, last_set = a[i], shingles(texts_a[i].as_py(), rule.words)
                other = shingles(texts_b[i].as_py(), rule.words)
                common = len(last_set & other)
                linked.append(100 * common >= rule.percent * (len(last_set) + len(other) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def link(pairs: DataFrame, signed: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that are linked, written."""
    sig = signed.select(F.col("doc_id").alias("id"), "sig")
    with_sig = pairs.join(sig.withColumnsRenamed({"id": "b", "sig": "sig_b"}), "b").join(sig.withColumnsRenamed({"id": "a", "sig": "sig_a"}), "a")
    alive = written(with_sig.select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(rule), "a long, b long"), "alive")
    ids = alive.select(F.col("a").alias("id")).union(alive.select("b")).distinct()
    text = texts.join(ids, texts["doc_id"] == ids["id"], "left_semi")
    # the leader's text comes last: its rows are then neighbours and its set is made once
    with_b = alive.join(text.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    both = with_b.join(text.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a").select("a", "b", "text_a", "text_b")
    out = written(both.mapInArrow(_verify(rule), "a long, b long"), "links")
    discard(alive)
    return out


def _by_bucket(members: DataFrame, *values) -> DataFrame:
    """An aggregate of each bucket, once for each of its salts: it joins members on bucket and salt.

    Members of a large bucket are spread over several salts, so the bucket's rows never meet in one task.
    """
    by = members.groupBy("bucket").agg(*values, F.max("salts").alias("salts"))
    return by.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def _open(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components."""
    split = _by_bucket(members, F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("bucket", "salt")
    return members.join(split, BUCKET)


def _spread(rule: Rule):
    def run(batches):
        hasher = _Hasher(rule)
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                sets = [hasher.sets(t.encode("utf-8", "surrogatepass").lower().split()) for t in part.column("text").to_pylist()]
                times = np.array([len(x) for x in sets])
                ids, comps = (np.repeat(part.column(c).to_numpy(), times) for c in ("id", "c"))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(comps), pa.array(np.concatenate(sets).view(np.int64))], names=["id", "c", "h"])

    return run


def reachable(members: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """members (bucket, salt, salts, id, n, c) that can have a link to another component, with s, the shingles they share with any.

    What a document has in common with one of another component is at most s,
    so with the smallest set of its bucket as partner it has an upper bound of
    similarity; below the limit it has no link there. Near copies that each
    have enough of their own leave in this way without being compared. Which
    shingles several components have is an aggregation that combines before it
    moves; the join back on a frequent shingle's rows can be split.
    """
    ids = members.select("id", "c").distinct()
    rows = written(texts.join(ids, texts["doc_id"] == ids["id"]).select("id", "c", "text").mapInArrow(_spread(rule), "id long, c long, h long"), "shingles")
    several = rows.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("h")
    counts = rows.join(several, "h", "left_semi").groupBy("id").agg(F.count("*").alias("s"))
    least = _by_bucket(members, F.min("n").alias("least"))
    bound = f"100 * s >= {rule.percent} * (n + least - s) AND 100 * s >= {rule.percent} * n"
    out = written(members.join(counts, "id").join(least, BUCKET).filter(bound).select(*BUCKET, "salts", "id", "n", "c", "s"), "reachable")
    discard(rows)
    return out


def _tile(rule: Rule):
    least = least_matches(rule)

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("outside", "descending"), ("id", "ascending")])
        ids, n, c, s = (rows[x].to_numpy() for x in ("id", "n", "c", "s"))
        outside = rows["outside"].to_numpy(zero_copy_only=False)
        # a pair of two outside meets in the one tile of their blocks, never in those with the largest component
        kind, i, j = (rows[x][0].as_py() for x in ("kind", "i", "j"))
        block = rows["block"].to_numpy()
        sigs = np.frombuffer(b"".join(rows["sig"].to_pylist()), "<u4").reshape(len(ids), -1)
        texts, sets = rows["text"], {}
        of = {x: x for x in c.tolist()}  # components of this tile that have met

        def root(x):
            while of[x] != x:
                x = of[x]
            return x

        def shingle_set(i):
            if i not in sets:
                sets[i] = shingles(texts[i].as_py(), rule.words)
            return sets[i]

        found_a, found_b = [], []
        for x in np.flatnonzero(outside if kind == "in" or i == j else outside & (block == i)).tolist():
            low = np.minimum(s, s[x])
            at = (c != c[x]) & (100 * np.minimum(n, n[x]) >= rule.percent * np.maximum(n, n[x])) & (100 * low >= rule.percent * (n + n[x] - low))
            if kind == "in":
                at &= ~outside
            elif i == j:
                at[: x + 1] = False  # a pair comes once
            else:
                at &= block == j
            alive, matches = np.flatnonzero(at), 0
            for k, most in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches = matches + (sigs[alive, part] == sigs[x, part]).sum(axis=1)
                stay = matches >= most
                alive, matches = alive[stay], matches[stay]
            for y in alive.tolist():
                if root(c[x]) == root(c[y]):
                    continue
                one, two = shingle_set(x), shingle_set(y)
                common = len(one & two)
                if 100 * common >= rule.percent * (len(one) + len(two) - common):
                    of[root(c[x])] = root(c[y])
                    found_a.append(min(ids[x], ids[y]))
                    found_b.append(max(ids[x], ids[y]))
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    return run


def finish(members: DataFrame, reps: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b), written, between members of different components that no leader has joined, none left out that could join two.

    Buckets that share documents form groups. In each group the documents
    outside its largest component meet all others, in tiles of TILE by TILE:
    what moves is documents, once for each tile of theirs, never pairs. Groups
    of long texts have more tiles, so a tile is bounded in shingles as well.
    Inside a tile the posterior prunes and the full sets decide.
    """
    star = members.join(_by_bucket(members, F.min("id").alias("l")), BUCKET).select(F.col("id").alias("a"), F.col("l").alias("b"))
    groups = components(star).withColumnRenamed("component", "g")
    m = members.select("id", "n", "c", "s").distinct().join(groups, "id")
    sizes = m.groupBy("g", "c").agg(F.count("*").alias("k"), F.sum("n").alias("v"))
    info = sizes.groupBy("g").agg(F.max(F.struct("k", "c", "v")).alias("x"), F.sum("k").alias("all"), F.sum("v").alias("volume"))
    tiles = lambda k, v: F.greatest(F.lit(1), F.ceil(k / TILE), F.ceil(v / TILE_SHINGLES)).cast("int")
    info = info.select("g", F.col("x.c").alias("top"), tiles(F.col("x.k"), F.col("x.v")).alias("inner"), tiles(F.col("all") - F.col("x.k"), F.col("volume") - F.col("x.v")).alias("outer"))
    m = m.join(info, "g").withColumn("outside", F.col("c") != F.col("top"))
    m = m.withColumn("at", F.pmod(F.xxhash64("id"), F.when(F.col("outside"), F.col("outer")).otherwise(F.col("inner"))).cast("int"))
    key = lambda i, kind, j: F.struct(i.alias("i"), F.lit(kind).alias("kind"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    of_outside = F.concat(F.transform(upto("inner"), lambda j: key(F.col("at"), "in", j)), F.transform(upto("outer"), lambda j: key(F.least(F.col("at"), j), "out", F.greatest(F.col("at"), j))))
    of_top = F.transform(upto("outer"), lambda i: key(i, "in", F.col("at")))
    m = m.join(reps.select(F.col("doc_id").alias("id"), "sig"), "id").join(texts.withColumnRenamed("doc_id", "id"), "id")
    dealt = m.withColumn("tile", F.explode(F.when(F.col("outside"), of_outside).otherwise(of_top)))
    dealt = dealt.select("g", "tile.i", "tile.kind", "tile.j", "id", F.col("n").cast("long").alias("n"), "c", "s", "outside", F.col("at").alias("block"), "sig", "text")
    return written(dealt.groupBy("g", "i", "kind", "j").applyInArrow(_tile(rule), "a long, b long"), "links")


def near_duplicates(df: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of df that has an id.

    Null and empty texts have no shingles and are linked with nothing. Rows that
    repeat an id have one component, what any of their texts is linked with;
    each has its own text's size. A null id is left out.
    """
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    signed = written(texts.mapInArrow(_sign(rule), SIGNED), "signed")
    keyed = signed.filter("key IS NOT NULL")
    classes = written(keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = written(keyed.join(classes, "key").filter("doc_id = rep").select("doc_id", "n_shingles", "sig").distinct(), "reps")
    # an id that comes with several texts joins what they belong to
    several = keyed.groupBy("doc_id").agg(F.count_distinct("key").alias("n")).filter("n > 1").select("doc_id")
    bound = written(keyed.join(several, "doc_id").join(classes, "key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "bound")

    hexed = F.hex("sig")
    width = 8 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(rule.bands - 1)), lambda i: F.xxhash64(i, F.substring(hexed, i * width + 1, F.lit(width))))
    rows = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").cast("int").alias("n"), F.explode(bands).alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    held = rows.join(shared, "bucket").withColumn("salts", F.when(F.col("members") > HOT, SALTS).otherwise(1)).drop("members")
    members = written(held.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")), "members")

    # whole texts move once, for members only; what comes after joins with these
    ids = members.select("id").distinct()
    texts = written(texts.hint("merge").join(ids, texts["doc_id"] == ids["id"], "left_semi"), "texts")
    comp, links, done, left = None, bound, None, members
    spent = [bound, members, texts]  # what the result does not read
    for turn in range(LEADER_ROUNDS + 1):
        if turn == 0:
            now = members.withColumn("c", F.col("id"))
        else:
            # only buckets that still hold several components, and of their members only those that can have a link to another
            now = left.withColumn("c", F.col("id"))
            if comp is not None:
                now = left.join(comp.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
            now = _open(now)
            if turn == 1:
                # components only grow, so what is shared with others can only fall: the bound holds for all later turns
                first = written(now, "open")
                now = _open(held := reachable(first, texts, rule))
                spent += [first, held]
            now = written(now, "open")
            spent.append(now)
            left = now.drop("c")
            if now.isEmpty():
                break
        if turn == LEADER_ROUNDS:
            found = finish(now, reps, texts, rule)
            spent.append(found)
            links = links.unionByName(found)
            comp = components(links)
            break
        # another leader each turn: the smallest id first, then the smallest of a hash
        rank = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
        shared = F.lit(None).cast("long") if turn == 0 else F.col("s")
        leaders = _by_bucket(now, F.min(F.struct(rank.alias("rank"), F.col("id").alias("l"), F.col("n").alias("ln"), F.col("c").alias("lc"), shared.alias("ls"))).alias("x"))
        other = leaders.select(*BUCKET, "x.l", "x.ln", "x.lc", "x.ls")
        fits = f"c <> lc AND 100 * least(n, ln) >= {rule.percent} * greatest(n, ln)"
        if turn:
            fits += f" AND 100 * least(s, ls) >= {rule.percent} * (n + ln - least(s, ls))"
        pairs = now.join(other, BUCKET).filter(fits).select(F.least("id", "l").alias("a"), F.greatest("id", "l").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        spent.append(pairs)
        if pairs.isEmpty():
            continue
        done = pairs if done is None else done.unionByName(pairs)
        found = link(pairs, reps, texts, rule)
        spent.append(found)
        links = links.unionByName(found)
        comp = components(links)

    if comp is None:
        comp = components(links)
    discard(*spent, reps)
    of_rep = classes.select("key", "rep").join(comp, F.col("rep") == comp["id"], "left").select("key", F.coalesce("component", "rep").alias("rep"))
    out = signed.select("doc_id", "n_shingles", "key").join(of_rep, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("component_id"))


def keep_first(df: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of df that are their component's smallest id, columns as they were; rows without an id stay, rows of one id stay together."""
    kept = near_duplicates(df, rule).filter("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    good = df.join(kept, df["doc_id"] == kept["_kept"], "left_semi")
    return good.unionByName(df.filter("doc_id IS NULL"))


def op8(spark, sf_dir):
    out = near_duplicates(documents(spark, sf_dir), Rule(words=3, percent=85))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a),
m AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = id"""
