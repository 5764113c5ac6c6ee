"""Operator 12, the exact n-gram Jaccard join, by partitions of the universe and the pigeonhole principle.

Sets of sizes s <= t with a Jaccard similarity of at least p percent differ in at most s * (100 - p) / p tokens. Sizes are cut into bands; a
band has one partition of all tokens into as many segments as its largest set may differ, and one more. So two similar sets have a segment in common that is the same in
both. A set indexes the subsets that fall into the segments of its own band, and of the lower bands in which it may have a partner.

Segments that many sets share cost much to look up. Every set needs only as many units of evidence as it may differ, and one more: a segment
that is looked up exactly is one, one that is looked up together with all its one-deletion neighbours (it may differ by one token) is two.
So common segments are left out where neighbourhoods of others are cheaper, by counted costs; the choice of either set of a pair suffices.

Links of equal sets are none: a distinct set is indexed once. Of many similar sets not all pairs are made: those that meet in a segment are
first verified against one pivot each, the member with most company; after that only pairs across components are. Candidates are verified on all tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.components import connected_components
from corvane.llm.skew import join_counted
from corvane.session import materialise

#: A segment that more sets than this share is common: it is looked up only where nothing else will do.
COMMON = 32
#: Ids up to this many are broadcast to find their texts; beyond it texts are shuffled once.
BROADCAST_IDS = 2_000_000
#: Members that meet one copy of their pivot.
PIVOT_SHARE = 500
#: Bits of a set's parity sketch: sets that differ in d tokens have sketches that differ in at most d bits.
SKETCH_WORDS = 4
PART = "array<struct<scheme:int,guest:boolean,need:int,sigs:array<long>>>"


def most_apart(size: int, percent: int) -> int:
    """Tokens in which a set may differ from a similar one that is no smaller."""
    return size * (100 - percent) // percent


def band_starts(least: int = 1, until: int = 1 << 40) -> list[int]:
    """Smallest sizes of the bands, each a quarter above the last."""
    out = [least]
    while out[-1] <= until:
        out.append(out[-1] * 5 // 4 + 1)
    return out


_STARTS = band_starts()


def schemes(size: int, percent: int) -> list[tuple[int, bool, int, int]]:
    """(scheme, guest, segments, evidence needed) of every partition in which a set of ``size`` is indexed."""
    from bisect import bisect_right

    band = lambda n: bisect_right(_STARTS, n) - 1
    own = band(size)
    out = []
    for scheme in range(own, band(-(-size * percent // 100)) - 1, -1):
        segments = most_apart(_STARTS[scheme + 1] - 1, percent) + 1
        out.append((scheme, scheme < own, segments, segments if scheme < own else most_apart(size, percent) + 1))
    return out


def tokens_of(text: str, shingle: int):
    """The distinct hashes of a text's shingles, sorted; a text with fewer words is one shingle, one without words has none."""
    import numpy as np

    from corvane.llm.wordwindows import Words, gram_hashes

    words = Words(text.encode().lower().decode())  # bytes: A-Z only
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(words.hashes(), min(shingle, len(words))))


def _weights(tokens, salt: int):
    import numpy as np

    h = (tokens ^ np.uint64(salt)) * np.uint64(0x9FB21C651E98DF25)
    h = (h ^ (h >> np.uint64(28))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def segment_sums(tokens, scheme: int, segments: int):
    """(segment of each token, its weight, the sum of weights of each segment and the salts that tell segments apart)."""
    import numpy as np

    at = (tokens % np.uint64(segments)).astype(np.int64)
    weights = _weights(tokens, 0x5851F42D4C957F2D)
    sums = np.zeros(segments, np.uint64)
    np.add.at(sums, at, weights)
    salts = _weights(np.arange(segments, dtype=np.uint64) + np.uint64(scheme << 40), 0x14057B7EF767814F)
    return at, weights, sums, salts


def _signature(sums, salts):
    return (_weights(sums + salts, 0x2545F4914F6CDD1D)).view("int64")


def _digest(tokens):
    """128 bits of a set, whatever the order of its tokens."""
    import numpy as np

    return [int(_weights(tokens, s).sum(dtype=np.uint64).view(np.int64)) if len(tokens) else 0 for s in (0x6A09E667F3BCC909, 0x3C6EF372FE94F82B)]


def _sketch(tokens) -> list[int]:
    import numpy as np

    bits = np.bincount((tokens >> np.uint64(32)).astype(np.int64) % (64 * SKETCH_WORDS), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _sets(shingle: int, percent: int, what: str):
    """From (doc_id, text) the sets' digests (``sizes``), their signatures (``parts``) or their tokens (``tokens``)."""

    def run(batches):
        import pyarrow as pa

        part = pa.list_(pa.struct([("scheme", pa.int32()), ("guest", pa.bool_()), ("need", pa.int32()), ("sigs", pa.list_(pa.int64()))]))
        more = {"sizes": [], "parts": [pa.field("parts", part), pa.field("sketch", pa.list_(pa.int64()))], "tokens": [pa.field("tokens", pa.binary())]}[what]
        schema = pa.schema([pa.field("doc_id", pa.int64()), *[pa.field(c, pa.int64()) for c in ("n", "hi", "lo")], *more])
        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows = []
                for doc_id, text in zip(b.column("doc_id")[at : at + 500].to_pylist(), b.column("text")[at : at + 500].to_pylist()):
                    tokens = tokens_of(text, shingle)
                    if what != "sizes" and not len(tokens):
                        continue
                    row = dict(zip(("doc_id", "n", "hi", "lo"), (doc_id, len(tokens), *_digest(tokens))))
                    if what == "parts":
                        found = [(s, g, need, _signature(*segment_sums(tokens, s, m)[2:])) for s, g, m, need in schemes(len(tokens), percent)]
                        row |= {"parts": [dict(zip(("scheme", "guest", "need", "sigs"), x)) for x in found], "sketch": _sketch(tokens)}
                    elif what == "tokens":
                        row["tokens"] = tokens.tobytes()
                    rows.append(row)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _neighbourhoods(percent: int):
    """From (set_no, tokens) every segment (``shorter`` 0) and all that one deletion leaves of it (1)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["set_no", "scheme", "seg", "sig", "shorter"]
        for b in batches:
            for set_no, raw in zip(b.column("set_no").to_pylist(), b.column("tokens").to_pylist()):
                tokens = np.frombuffer(raw, np.uint64)
                for scheme, _, segments, _ in schemes(len(tokens), percent):
                    at, weights, sums, salts = segment_sums(tokens, scheme, segments)
                    whole, less = _signature(sums, salts), _signature(sums[at] - weights, salts[at])
                    seg = np.concatenate([np.arange(segments), at]).astype(np.int32)
                    n = len(seg)
                    columns = [np.full(n, set_no, np.int64), np.full(n, scheme, np.int32), seg, np.concatenate([whole, less])]
                    shorter = np.concatenate([np.zeros(segments, np.int32), np.ones(n - segments, np.int32)])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, shorter)], names=names)

    return run


def _verify(percent: int):
    """From (a, salt, b, tokens), sorted, each pivot (no b) before its members: (a, b) of those that are similar."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        key, pivot = None, None
        for b in batches:
            out = []
            for a, salt, member, raw in zip(*[b.column(c) for c in ("a", "salt", "b", "tokens")]):
                tokens = np.frombuffer(raw.as_buffer(), np.uint64)
                if not member.is_valid:
                    key, pivot = (a.as_py(), salt.as_py()), tokens
                    continue
                if key != (a.as_py(), salt.as_py()):
                    raise RuntimeError("a member came without its pivot")
                both = len(np.intersect1d(pivot, tokens, assume_unique=True))
                if 100 * both >= percent * (len(pivot) + len(tokens) - both):
                    out.append((key[0], member.as_py()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b"])

    return run


def _similar(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) that are similar. Members of one a are dealt into shares, each with a copy of a's tokens."""
    pairs = materialise(pairs, "pairs")
    shares = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("shares", F.ceil(F.col("n") / PIVOT_SHARE).cast("int"))
    shares = materialise(shares, "shares")
    dealt = join_counted(pairs, shares, "a", "n", pairs.count()).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int"))
    members = dealt.join(tokens.withColumnRenamed("set_no", "b"), "b").select("a", "salt", "b", "tokens")
    pivots = shares.join(tokens.withColumnRenamed("set_no", "a"), "a")
    pivots = pivots.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "tokens")
    met = pivots.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return materialise(met.mapInArrow(_verify(percent), "a long, b long"), "links")


def _may_be_similar(x: str, y: str, percent: int) -> Column:
    """Of two rows with n, sketch and component: across components, and neither sizes nor sketches rule it out."""
    col = lambda side, c: F.col(f"{side}.{c}")
    less, more = F.least(col(x, "n"), col(y, "n")), F.greatest(col(x, "n"), col(y, "n"))
    differ = sum(F.bit_count(col(x, "sketch")[i].bitwiseXOR(col(y, "sketch")[i])) for i in range(SKETCH_WORDS))
    # a set of size s and one of size t with i tokens in common differ in s + t - 2 * i, and 100 * i >= percent * (s + t - i)
    bound = less + more - 2 * F.ceil(percent * (less + more) / (100 + percent))
    return (col(x, "comp") != col(y, "comp")) & (100 * less >= percent * more) & (differ <= bound)


def similar_sets(docs: DataFrame, percent: int = 90, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id reachable by links.

    A text's set is its distinct runs of ``shingle`` words, A-Z lower-cased; two texts link when their Jaccard similarity is at least
    ``percent``. Null texts and those without words have no shingle and link with nothing. Rows with a null id take part; where all of a
    component have one, component_id is null. Repeated rows come out as often as they went in; an empty table gives an empty result. Only id and text
    are read, so other columns can't clash. A text's set is held whole by one task at a time: 8 bytes a shingle.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = "doc_id long, n long, hi long, lo long"
    sized = materialise(rows.mapInArrow(_sets(shingle, percent, "sizes"), base), "set-sizes")
    wide = rows.mapInArrow(_sets(shingle, percent, "parts"), f"{base}, parts {PART}, sketch array<long>")
    sets = wide.groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("doc_id"), F.first("parts").alias("parts"), F.first("sketch").alias("sketch"), F.count("*").alias("n_docs"))
    # written, so the numbers stay
    sets = materialise(sets.withColumn("set_no", F.monotonically_increasing_id()), "sets")
    links = _links(rows, sets, percent, shingle)

    roots = connected_components(links).select(F.col("node").alias("set_no"), "root")
    placed = sets.select("set_no", "hi", "lo", "n", "doc_id", "n_docs").join(roots, "set_no", "left").withColumn("root", F.coalesce("root", "set_no"))
    placed = materialise(placed, "placed")
    components = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n_sets"))
    components = materialise(components.where("n_sets > 1"), "components")
    together = join_counted(placed, components, "root", "n_sets", placed.count())
    alone = placed.join(components.select("root"), "root", "left_anti").withColumn("component_id", F.col("doc_id"))
    digest = F.struct("hi", "lo", "n").alias("digest")
    columns = [digest, "component_id", "n_docs"]
    by_digest = materialise(together.select(*columns).unionByName(alone.select(*columns)), "by-digest")
    known = join_counted(sized.where("n > 0").select("doc_id", digest), by_digest, "digest", "n_docs", sized.count())
    known = known.select("doc_id", F.col("digest.n").alias("n_shingles"), "component_id")
    return known.unionByName(sized.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _links(rows: DataFrame, sets: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(a, b): set numbers of similar sets, enough of them to connect all that are."""
    part = sets.select("set_no", "n", F.explode("parts").alias("part"))
    every = part.select("set_no", "n", "part.scheme", "part.guest", "part.need", F.size("part.sigs").alias("segments"), F.posexplode("part.sigs").alias("seg", "sig"))
    shared = materialise(every.groupBy("sig").agg(F.count("*").alias("n_sets")).where("n_sets > 1"), "shared")
    n_every = sets.agg(F.sum(F.expr("aggregate(parts, 0L, (a, p) -> a + size(p.sigs))"))).first()[0] or 0
    entries = materialise(join_counted(every, shared, "sig", "n_sets", n_every), "entries")
    n_entries = entries.count()

    company = materialise(entries.groupBy("set_no").agg(F.sum("n_sets").alias("company")), "company")
    busy = sets.select("set_no", "doc_id", "hi", "lo", "n", "sketch").join(company, "set_no")
    busy = materialise(busy, "busy")
    tokens = _tokens(rows, busy, percent, shingle)

    ranked = entries.select("sig", "set_no").join(company, "set_no")
    pivots = ranked.groupBy("sig").agg(F.max(F.struct("company", "set_no"))["set_no"].alias("pivot"), F.count("*").alias("n_sets"))
    met = join_counted(entries.select("sig", "set_no"), materialise(pivots, "pivots"), "sig", "n_sets", n_entries)
    first = _similar(met.where("set_no != pivot").select(F.col("pivot").alias("a"), F.col("set_no").alias("b")).distinct(), tokens, percent)

    roots = connected_components(first).select(F.col("node").alias("set_no"), "root")
    members = busy.select("set_no", "sketch").join(roots, "set_no", "left").select("set_no", "sketch", F.coalesce("root", "set_no").alias("comp"))
    members = materialise(members, "members")
    # segments in which components meet; in the others no link is missing that would connect anything
    meeting = entries.select("sig", "set_no").join(members.select("set_no", "comp"), "set_no").groupBy("sig", "comp").agg(F.count("*").alias("n"))
    meeting = meeting.groupBy("sig").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.sum("n").alias("n_here"), F.count("*").alias("n_comps"))
    meeting = materialise(meeting.where("n_comps > 1").select("sig", "main", "n_here"), "meeting")
    open_ = join_counted(entries, meeting, "sig", "n_here", n_entries).join(members, "set_no")
    open_ = materialise(open_, "open")
    few = open_.where(F.col("n_sets") <= COMMON)
    x, y = few.alias("x"), few.alias("y")
    once = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.set_no") < F.col("y.set_no")) & ~(F.col("x.guest") & F.col("y.guest"))
    pairs = x.join(y, once & _may_be_similar("x", "y", percent)).select("x.set_no", F.col("y.set_no").alias("other"))
    common = open_.where(F.col("n_sets") > COMMON)
    if not common.isEmpty():
        pairs = pairs.unionByName(_across_common(common, members, busy, tokens, percent))
    ends = [F.least("set_no", "other").alias("a"), F.greatest("set_no", "other").alias("b")]
    return first.unionByName(_similar(pairs.select(*ends).distinct(), tokens, percent))


def _tokens(rows: DataFrame, busy: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(set_no, tokens) of sets that share a segment with another, made anew of one text each."""
    ids = busy.select(F.col("doc_id").alias("id")).distinct()
    if busy.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    found = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").mapInArrow(_sets(shingle, percent, "tokens"), "doc_id long, n long, hi long, lo long, tokens binary")
    keyed = found.drop("doc_id").join(busy.select("hi", "lo", "n", "set_no"), ["hi", "lo", "n"])
    return materialise(keyed.groupBy("set_no").agg(F.first("tokens").alias("tokens")), "tokens")


def _across_common(common: DataFrame, members: DataFrame, busy: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """(set_no, other): candidates that may be missed where common segments aren't looked up, and those of the ones that are.

    Of the sets with a common segment, those whose other segments give evidence enough find all their partners by them. The rest take what costs
    least: one-deletion neighbourhoods of other segments, or common segments, which they look up among their like.
    """
    place = ["set_no", "scheme"]
    lacking = common.groupBy(*place).agg((F.first("need") - F.first("segments") + F.count("*")).alias("lack")).where("lack > 0")
    lacking = materialise(lacking, "lacking")
    crowded = materialise(common.select("set_no").distinct(), "crowded")
    around = tokens.join(crowded, "set_no").mapInArrow(_neighbourhoods(percent), "set_no long, scheme int, seg int, sig long, shorter int")
    around = materialise(around, "neighbourhoods")
    whole, less = around.where("shorter = 0").drop("shorter"), around.where("shorter = 1").drop("shorter")
    count = lambda df, n: df.groupBy("sig").agg(F.count("*").alias(n))
    both = materialise(count(whole, "n_whole").join(count(less, "n_less"), "sig"), "neighbours")  # only segments that differ by one token somewhere
    n_around = around.count()
    near_less = join_counted(less, both, "sig", "n_less", n_around)
    near_whole = join_counted(whole, both, "sig", "n_whole", n_around)
    cost = near_less.select(*place, "seg", F.col("n_whole").alias("cost")).unionByName(near_whole.select(*place, "seg", F.col("n_less").alias("cost")))
    cost = cost.groupBy(*place, "seg").agg(F.sum("cost").alias("cost"))

    taken = common.select(*place, "seg", F.col("n_sets").alias("shared_by"))
    options = whole.join(lacking, place).join(taken, [*place, "seg"], "left").join(cost, [*place, "seg"], "left")
    options = options.withColumn("price", F.coalesce("shared_by", "cost", F.lit(0)))
    order = Window.partitionBy(*place).orderBy("price", "seg")
    chosen = options.withColumn("nth", F.row_number().over(order)).where("nth <= lack AND price > 0")
    chosen = materialise(chosen.select(*place, "seg", "sig", F.col("shared_by").isNotNull().alias("common")), "chosen")

    facts = members.join(busy.select("set_no", "n"), "set_no")
    known = lambda df, *c: df.join(facts, "set_no").select("set_no", "n", "sketch", "comp", "sig", *c)
    apart = _may_be_similar("x", "y", percent)
    meet = lambda x, y, on: x.alias("x").join(y.alias("y"), (F.col("x.sig") == F.col("y.sig")) & apart & on).select("x.set_no", F.col("y.set_no").alias("other"))
    wider = chosen.where("NOT common")
    differ = F.col("x.set_no") != F.col("y.set_no")
    by_one_more = meet(known(wider), known(near_less), differ)
    by_one_less = meet(known(near_less.join(wider.select(*place, "seg"), [*place, "seg"])), known(near_whole), differ)
    index = common.join(lacking, place).select("set_no", "n", "sketch", "comp", "sig", (F.col("comp") == F.col("main")).alias("in_main"))
    ask = common.where("comp != main").join(chosen.where("common").select(*place, "seg"), [*place, "seg"]).select("set_no", "n", "sketch", "comp", "sig")
    by_common = meet(ask, index, F.col("y.in_main") | (F.col("x.set_no") > F.col("y.set_no")))
    return by_one_more.unionByName(by_one_less).unionByName(by_common)
