"""Secret scan with corpus-wide ownership frequency (DataFrame functions only).

``scan`` finds candidates in every text; ``ownership`` counts, for the hash of
each candidate value, the distinct repositories and owners that hold it;
``judge`` separates values copied widely (documentation examples) from the
others that look live; ``redact`` takes the live ones out of the texts.

Cases: a NULL text is an empty one and has no spans; rows that repeat are
scanned row by row and count as one owner; a NULL id, repository or owner is a
value of its own; an empty table gives an empty table; further columns of the
input are not looked at (``redact`` passes them through).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelage.llm.decontamination import let
from pelage.llm.storage import stored
from pelage.operators.prefix import unused

c = F.col

# The patterns of the base kinds and the least length of each.
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "live", "copied")
LEAST = {"assign": 6, "access": 20, "hex": 24}
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|your|changeme|x{4}|0{6}|1{6}|123456|abcdef0"

SPANS = "array<struct<start:bigint,rank:int,end:bigint,value_start:bigint,hash:string,looks_live:boolean>>"
NONE = f"CAST(array() AS {SPANS})"


def _looks_live(value: Column) -> Column:
    """Long enough, letters and digits mixed, no placeholder wording."""
    return ((F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER))


def _upto(values: Column, join) -> Column:
    """Running sums or maxima of an array, by doubling: each round joins every value with the one 1, 2, 4, ... before it.

    A fold that appends to its result copies it for each value; here a text
    with n matches takes n log n steps.
    """
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))
    return F.aggregate(rounds, values, lambda done, r: F.transform(done, lambda x, i: F.when(
        i >= F.pow(F.lit(2), r).cast("int"),
        join(x, F.get(done, i - F.pow(F.lit(2), r).cast("int")))).otherwise(x)))


def _spans(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Spans of all matches of one kind.

    The matches and the pieces between them alternate, so running lengths give
    the positions; ``group`` is the capture that holds the value and it ends
    where the match ends.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)
    rank = KINDS.index(kind)

    def spans(found: Column) -> Column:
        ends = _upto(F.transform(found, lambda x: (F.length(x["piece"]) + F.length(x["match"])).cast("bigint")), lambda x, y: x + y)
        return F.transform(F.arrays_zip(found.alias("item"), ends.alias("end")), lambda x: F.struct(
            (x["end"] - F.length(x["item"]["match"])).alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"),
            (x["end"] - F.length(x["item"]["value"])).alias("value_start"), F.sha2(x["item"]["value"], 256).alias("hash"),
            F.coalesce(_looks_live(x["item"]["value"]), F.lit(False)).alias("looks_live")))

    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("piece"), matches.alias("match"), values.alias("value"))
    whole = let(zipped, spans)
    return F.filter(whole, lambda s: s["end"] - s["value_start"] >= LEAST[kind])


def find_spans(text: Column) -> Column:
    """All base spans of a text, by start and then kind."""
    text = F.coalesce(text, F.lit(""))
    hint = r"[sS][wW][oO]?[rR]?[dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
    kinds = (("assign", ASSIGN, 2, hint), ("access", ACCESS, 0, "AKIA"), ("hex", HEX, 0, HEX))
    found = [F.when(text.rlike(guard), _spans(text, kind, pattern, group)).otherwise(F.expr(NONE))
             for kind, pattern, group, guard in kinds]
    return F.array_sort(F.concat(*found))


def scan(docs: DataFrame, id_col: str, text_col: str, repo: Column, owner: Column) -> DataFrame:
    """One row per input row: ``id, repo, owner, spans``."""
    return docs.select(c(id_col).alias("id"), repo.alias("repo"), owner.alias("owner"),
                       find_spans(c(text_col)).alias("spans"))


def ownership(scanned: DataFrame) -> DataFrame:
    """``hash, n_repos, n_owners, n_places``: how far each candidate value has spread.

    The first grouping sums up one value within one owner before anything
    else meets, so a value in a third of all rows is a few rows per task.
    """
    places = scanned.select("repo", "owner", F.explode("spans").alias("s")).select(
        "repo", "owner", c("s.hash").alias("hash"))
    held = places.groupBy("hash", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    # Distinct counts are grouped by (hash, repository) and (hash, owner) first; a struct counts NULL as a value.
    return held.groupBy("hash").agg(
        F.count_distinct(F.struct("repo")).alias("n_repos"), F.count_distinct(F.struct("owner")).alias("n_owners"),
        F.sum("n").alias("n_places"))


# Rows of a candidate value that meet one copy of its verdict.
PLACES_PER_COPY = 50_000
# Values that are copied at most: beyond some hundreds no value can be in a large share of the rows.
COMMON_VALUES = 1_000


def judge(scanned: DataFrame, min_copied_owners: int = 3, min_copied_repos: int = 2) -> DataFrame:
    """``id, verdicts``: for each id the map from candidate hash to ``live`` or ``copied``.

    A value is copied when at least ``min_copied_owners`` owners hold it in at
    least ``min_copied_repos`` repositories, and otherwise live when it looks
    like a real credential. Other values get no verdict. Ids without verdict
    have no row. A value that very many rows hold comes in as many copies, and
    its rows are dealt out over them.
    """
    spread = stored(ownership(scanned), "secret-spread")
    copies = F.greatest(F.ceil(c("n_places") / PLACES_PER_COPY), F.lit(1)).cast("int")
    held = scanned.select("id", F.explode("spans").alias("s")).select(
        "id", c("s.hash").alias("hash"), c("s.looks_live").alias("looks_live")).distinct()
    verdict = (F.when((c("n_owners") >= min_copied_owners) & (c("n_repos") >= min_copied_repos), "copied")
               .when(c("looks_live"), "live"))
    # The few values of many places are known by name; all others have one copy.
    common = {r["hash"]: r["copies"] for r in spread.where(copies > 1).select("hash", copies.alias("copies")).orderBy(
        c("copies").desc()).limit(COMMON_VALUES).collect()}
    named = F.create_map(*[F.lit(x) for pair in common.items() for x in pair]) if common else None
    of = F.coalesce(named[c("hash")], F.lit(1)) if common else F.lit(1)
    dealt = held.withColumn("copy", F.pmod(F.xxhash64("id"), of).cast("int"))
    owned = spread.withColumn("copy", F.explode(F.sequence(F.lit(0), of - 1)))
    return (dealt.join(owned, ["hash", "copy"]).select("id", "hash", verdict.alias("verdict")).where("verdict IS NOT NULL")
            .groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("hash", "verdict"))).alias("verdicts")))


def report(scanned: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per scanned row: ``id``, counts per kind, base spans and all spans as text."""
    v = verdicts.select(c("id").alias("_id"), "verdicts")
    df = scanned.join(v, c("id").eqNullSafe(c("_id")), "left")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == KINDS.index(kind))).cast("long")

    def shown(spans: Column) -> Column:
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    place = "array<struct<start:bigint,rank:int,end:bigint>>"
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"),
                                                  s["end"].alias("end"))).cast(place)
    added = F.when(c("verdicts").isNotNull(), F.transform(
        F.filter("spans", lambda s: c("verdicts")[s["hash"]].isNotNull()),
        lambda s: F.struct(s["value_start"].alias("start"),
                           F.when(c("verdicts")[s["hash"]] == "live", 3).otherwise(4).alias("rank"),
                           s["end"].alias("end"))).cast(place)).otherwise(F.expr(f"CAST(array() AS {place})"))
    return df.select("id", *[count(k).alias(f"n_{k}") for k in LEAST], shown(base).alias("base"),
                     shown(F.array_sort(F.array_distinct(F.concat(base, added)))).alias("spans"))


def redact(docs: DataFrame, id_col: str, text_col: str, verdicts: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the live values of each text replaced by ``mark``; all columns as they were."""
    own_id, own_verdicts = unused(docs, "redact_id", "redact_verdicts")
    v = verdicts.where(F.exists(F.map_values("verdicts"), lambda x: x == "live")).select(
        c("id").alias(own_id), c("verdicts").alias(own_verdicts))
    joined = docs.join(v, c(id_col).eqNullSafe(c(own_id)), "left")
    text = F.coalesce(c(text_col), F.lit(""))
    live = F.array_sort(F.transform(
        F.filter(find_spans(c(text_col)), lambda s: c(own_verdicts)[s["hash"]] == "live"),
        lambda s: F.struct(s["value_start"].alias("start"), s["end"].alias("end"))))

    def cut(spans: Column) -> Column:
        """The text before each span that begins behind all earlier ones, with a mark; then what is left."""
        reached = _upto(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))

        def piece(s: Column, i: Column, ends: Column) -> Column:
            before = F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0).cast("bigint"))
            return F.when(s["start"] >= before, F.concat(
                F.substring(text, (before + 1).cast("int"), (s["start"] - before).cast("int")), F.lit(mark))).otherwise(F.lit(""))

        return let(reached, lambda ends: F.concat(
            F.array_join(F.transform(spans, lambda s, i: piece(s, i, ends)), ""),
            F.substring(text, (F.element_at(ends, -1) + 1).cast("int"), F.length(text))))

    cleaned = let(live, lambda spans: F.when(F.size(spans) > 0, cut(spans)).otherwise(text))
    return joined.withColumn(text_col, F.when(c(own_verdicts).isNull(), c(text_col)).otherwise(
        F.when(c(text_col).isNotNull(), cleaned))).select(*[c(k) for k in docs.columns])
