"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixrel.llm.common import saved

#: Words of a block, documents of a shard (on average), and the seed of the order in which blocks are taken.
BLOCK_WORDS, SHARD_DOCS, SEED = 64, 4096, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """sources (__key, source, source_size) gain target: shares of the whole by weight, none above cap times its size.

    Water-filling in closed form. In order of cap per weight, a source is capped while the level that the others
    would get without it lies above its own; one row a source passes through one sorted window.
    """
    one = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(one.orderBy(F.col("source").isNull(), "source"))
    by_room = one.orderBy("__room", "__key").rowsBetween(Window.unboundedPreceding, -1)
    s = sources.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("__cap", cap * F.col("source_size")).withColumn("__room", F.col("__cap") / F.col("__w"))
    s = s.withColumn("__all", F.sum("source_size").over(one)).withColumn("__ws", F.sum("__w").over(one))
    s = s.withColumn("__level", (F.col("__all") - F.coalesce(F.sum("__cap").over(by_room), F.lit(0))) / (F.col("__ws") - F.coalesce(F.sum("__w").over(by_room), F.lit(0))))
    s = s.withColumn("__full", F.col("__level") > F.col("__room"))
    s = s.withColumn("__rest", F.col("__all") - F.sum(F.when(F.col("__full"), F.col("__cap")).otherwise(0)).over(one)).withColumn("__open", F.sum(F.when(F.col("__full"), 0).otherwise(F.col("__w"))).over(one))
    target = F.when(F.col("__full") | (F.col("source_size") == 0), F.col("__cap").cast("double")).otherwise(F.col("__rest") / F.col("__open") * F.col("__w"))
    return s.select(*sources.columns, target.alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """parties gain __quota: seats of their group, dealt by the highest quotients weight / (2 k + 1), ties by key.

    Seats that surely belong to a party are counted in closed form from two divisors that bound the deciding one,
    so that about three quotients a party are made and ranked, however many seats there are.
    """
    w = Window.partitionBy(*(group or [F.lit(0)]))
    p = parties.withColumn("__n", F.sum(F.when(F.col(weight) > 0, 1).otherwise(0)).over(w)).withColumn("__sum", F.sum(weight).over(w))
    share = F.col(weight) / F.col("__sum")
    low = F.greatest(F.lit(0), F.ceil(share * (F.col(seats) - F.col("__n") / 2) - 0.5) - 1)
    high = F.ceil(share * (F.col(seats) + F.col("__n") / 2) - 0.5) + 1
    live = (F.col(weight) > 0) & (F.col(seats) > 0)
    p = p.withColumn("__low", F.when(live, low).otherwise(0).cast("long")).withColumn("__high", F.when(live, F.greatest(high, low + 1)).otherwise(0).cast("long"))
    p = p.withColumn("__left", F.col(seats) - F.sum("__low").over(w))
    tried = p.withColumn("__k", F.explode_outer(F.when(F.col("__high") > F.col("__low"), F.sequence(F.col("__low"), F.col("__high") - 1))))
    order = w.orderBy((F.col(weight) / (2 * F.col("__k") + 1)).desc_nulls_last(), key)
    tried = tried.withColumn("__won", (F.col("__k").isNotNull() & (F.row_number().over(order) <= F.col("__left"))).cast("long"))
    return tried.groupBy(*parties.columns, "__low").agg(F.sum("__won").alias("__won")).select(*parties.columns, (F.col("__low") + F.col("__won")).alias("__quota"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: str = SEED, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source (as given), size, source_size, target, taken.

    Sources in code point order, null last, weigh 5, 2, 1, repeating. Blocks of equally many words go to sources by
    Sainte-Laguë, then to the source's shards (about shard_docs documents, by a seeded hash of the id) likewise.
    A shard's documents, in seeded order, form a stream of blocks; its quota is taken from the stream's start, over
    again where it exceeds the shard, never beyond cap times the shard. Null and empty texts have size 0 and nothing
    is taken; repeated ids are documents of their own; an empty table gives no row; other columns are not read.
    """
    sized = saved(docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("~")).alias("__key"), word_count(F.col(text)).alias("size")), "sizes")
    per_source = sized.groupBy("__key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__docs"))
    targets = capped_targets(per_source, weights, cap)
    everything = Window.partitionBy(F.lit(0))
    quotas = sainte_lague(targets.withColumn("__seats", F.round(F.sum("target").over(everything) / block).cast("long")), [], "__key", "target", "__seats")
    quotas = quotas.select("__key", "source_size", "target", F.ceil(F.col("__docs") / shard_docs).alias("__shards"), F.col("__quota").alias("__blocks"))
    drawn = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    d = sized.join(quotas, "__key").withColumn("__draw", drawn)
    d = d.withColumn("__shard", F.conv(F.substring("__draw", 1, 8), 16, 10).cast("long") % F.col("__shards"))
    shards = d.groupBy("__key", "__shard").agg(F.sum("size").alias("__shard_size"), F.first("__blocks").alias("__blocks"))
    shards = sainte_lague(shards, ["__key"], "__shard", "__shard_size", "__blocks")
    shards = shards.select("__key", "__shard", "__shard_size", F.least(F.col("__quota") * block, F.col("__shard_size") * cap).alias("__words"))
    d = d.join(shards, ["__key", "__shard"])
    end = F.sum("size").over(Window.partitionBy("__key", "__shard").orderBy("__draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("__end", end).withColumn("__part", F.when(F.col("__shard_size") > 0, F.col("__words") % F.col("__shard_size")).otherwise(0))
    once = F.least("__end", "__part") - F.least(F.col("__end") - F.col("size"), F.col("__part"))
    passes = F.when(F.col("__shard_size") > 0, F.expr("__words div __shard_size")).otherwise(0)
    return d.select("doc_id", "source", "size", "source_size", "target", (passes * F.col("size") + once).cast("long").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The first n words of a text, with the white space between and after them."""
    pieces = F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def take_mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options: object) -> DataFrame:
    """docs as the mix takes them: a document comes once for each full pass, and with its first words for a part.

    All columns stay. Rows that nothing is taken of go. Rows alike in id, source and size share evenly what is taken
    of them.
    """
    taken = mix(docs, id_col=id_col, text=text, source=source, **options).groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__words")).agg(F.sum("taken").alias("__taken"), F.count(F.lit(1)).alias("__rows"))
    d = docs.withColumn("__size", word_count(docs[text]))
    d = d.join(taken, d[id_col].eqNullSafe(F.col("__id")) & d[source].eqNullSafe(F.col("__source")) & (F.col("__size") == F.col("__words")))
    place = F.when(F.col("__rows") > 1, F.row_number().over(Window.partitionBy("__id", "__source", "__words").orderBy(F.col(text)))).otherwise(1)
    d = d.withColumn("__own", F.expr("__taken div __rows") + (place <= F.col("__taken") % F.col("__rows")).cast("long")).filter("__own > 0")
    copies = F.sequence(F.lit(1).cast("long"), F.expr("__own div __size + if(__own % __size > 0, 1, 0)"))
    d = d.withColumn("__copy", F.explode(copies))
    d = d.withColumn(text, F.when(F.col("__copy") * F.col("__size") <= F.col("__own"), F.col(text)).otherwise(first_words(F.col(text), F.col("__own") % F.col("__size"))))
    return d.select(*docs.columns)


def oracle_sql(block: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: str = SEED) -> str:
    """The same in DuckDB SQL, but with every quotient made and ranked."""
    return rf"""
with d as (select doc_id, source, coalesce('=' || source, '~') k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
                  md5('{seed}:' || coalesce(doc_id::varchar, '')) draw from documents),
s as (select k, source, sum(size)::bigint source_size, count(*) docs from d group by k, source),
w as (select *, [5, 2, 1][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::bigint w, 3 * source_size cap from s),
r as (select *, cap / w room, sum(source_size) over () total, sum(w) over () ws from w),
l as (select *, (total - coalesce(sum(cap) over b, 0)) / (ws - coalesce(sum(w) over b, 0)) > room is_full from r window b as (order by room, k rows between unbounded preceding and 1 preceding)),
t as (select *, case when is_full or source_size = 0 then cap::double else (total - sum(case when is_full then cap else 0 end) over ()) / (sum(case when is_full then 0 else w end) over ()) * w end target from l),
n as (select *, round(sum(target) over () / {block})::bigint seats from t),
q as (select k, row_number() over (order by target / (2 * i + 1) desc, k) place, seats from n, lateral unnest(range(0, seats + 1)) u(i) where target > 0),
b as (select k, count(*) blocks from q where place <= seats group by k),
m as (select d.*, n.source_size, n.target, coalesce(b.blocks, 0) blocks, (('0x' || substr(draw, 1, 8))::bigint % ceil(docs / {shard_docs})::bigint) shard from d join n using (k) left join b using (k)),
h as (select k, shard, sum(size)::bigint shard_size, first(blocks) blocks from m group by k, shard),
hq as (select k, shard, row_number() over (partition by k order by shard_size / (2 * i + 1) desc, shard) place, blocks from h, lateral unnest(range(0, blocks + 1)) u(i) where shard_size > 0),
hw as (select k, shard, shard_size, least(3 * shard_size, {block} * (select count(*) from hq where hq.k = h.k and hq.shard = h.shard and place <= hq.blocks)) words from h),
e as (select m.*, shard_size, words, sum(size) over (partition by k, shard order by draw, doc_id, size rows unbounded preceding) stop from m join hw using (k, shard)),
p as (select *, case when shard_size > 0 then words % shard_size else 0 end part, case when shard_size > 0 then words // shard_size else 0 end passes from e)
select doc_id, size, source_size, target, (passes * size + least(stop, part) - least(stop - size, part))::bigint taken from p"""
