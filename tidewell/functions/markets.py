"""Raw market records into typed market tables, as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .questions import KINDS, Kind, extract_asset, extract_timeframe, has_phrase, kind_of
from .scalars import iso_seconds, json_list, let, text_or_null

#: A raw record as a feed gives it; list fields may be JSON text.
RAW = (
    "id string, question string, startDate string, start_date string, endDate string, end_date string, closed boolean, closedTime string, closed_time string, volume string, slug string, "
    "conditionId string, condition_id string, groupItemThreshold string, groupItemTitle string, outcomes string, outcomePrices string, clobTokenIds string, "
    "tokens array<struct<outcome:string,token_id:string,tokenId:string,winner:boolean>>, is_active boolean"
)
#: Price from which an outcome has won.
WON = 0.99


def outcome_pairs() -> Column:
    """array<struct<outcome, token_id>>: the nested tokens if all are filled, else the two lists side by side, else empty."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    filled = lambda a: (F.size(a) > 0) & F.forall(a, lambda t: (t["outcome"] != "") & (t["token_id"] != ""))
    nested = F.transform("tokens", lambda t: F.struct(text(t["outcome"]).alias("outcome"), text(F.coalesce(text_or_null(t["token_id"]), t["tokenId"])).alias("token_id")))

    def side_by_side(lists: Column) -> Column:
        zipped = F.transform(F.arrays_zip(lists["names"].alias("a"), lists["ids"].alias("b")), lambda z: F.struct(text(z["a"]).alias("outcome"), text(z["b"]).alias("token_id")))
        return F.when(F.size(lists["names"]) == F.size(lists["ids"]), let(zipped, lambda z: F.when(filled(z), z)))

    lists = F.struct(json_list("outcomes").alias("names"), json_list("clobTokenIds").alias("ids"))
    own = let(nested, lambda a: F.when(filled(a), a))
    return F.coalesce(own, let(lists, side_by_side), F.array().cast("array<struct<outcome:string,token_id:string>>"))


def _side(pairs: str, phrases: tuple[str, ...], but: tuple[str, ...] = ()) -> Column:
    """The last pair whose outcome has one of the phrases (and none of the other side's, which are tried first)."""
    hits = F.filter(pairs, lambda t: has_phrase(t["outcome"], phrases) & (~has_phrase(t["outcome"], but) if but else F.lit(True)))
    return F.get(F.reverse(hits), F.lit(0))


def price_resolution() -> Column:
    """1 or 0 for the first outcome once a closed market has a winner by price; else null."""
    prices = F.transform(json_list("outcomePrices"), lambda p: p.try_cast("double"))
    decided = F.coalesce(F.col("closed"), F.lit(False)) & F.exists(prices, lambda p: F.coalesce(p >= WON, F.lit(False)))
    first = F.get(prices, F.lit(0))
    return F.when(decided & first.isNotNull(), F.when(first >= WON, 1).otherwise(0)).cast("tinyint")


def event_slug() -> Column:
    """The slug without the bucket's label at its end ("240+" stands there as 240-plus)."""
    suffix = F.concat(F.lit("-"), F.replace(F.lower("bucket_label"), F.lit("+"), F.lit("-plus")))
    return F.when(F.col("bucket_label").isNotNull() & F.col("slug").endswith(suffix), F.expr("left(slug, length(slug) - length(concat('-', replace(lower(bucket_label), '+', '-plus'))))")).otherwise(F.col("slug"))


def normalize_markets(raw: DataFrame, kinds: tuple[Kind, ...] = KINDS, now_ts: Column | None = None) -> DataFrame:
    """Typed records of the raw ones that can be understood, with a column category (crypto or culture).

    Left out: questions of no kind, without timeframe or asset, with unreadable times or a start not before the end, and
    binary markets without an up and a down side. A market without an end counts as ending now.
    """
    now = now_ts if now_ts is not None else F.unix_timestamp()
    given_end = F.coalesce(text_or_null("end_date"), text_or_null("endDate"))

    def parsed(key: Column) -> Column:
        return F.struct(
            key.alias("_kind"),
            extract_timeframe("question", kinds, strict=True, key=key).alias("timeframe"),
            extract_asset("question", kinds, strict=True, key=key).alias("crypto"),
            iso_seconds(F.coalesce(text_or_null("start_date"), F.col("startDate"))).alias("start_ts"),
            F.when(given_end.isNull(), now).otherwise(iso_seconds(given_end)).alias("end_ts"),
            iso_seconds(F.coalesce(text_or_null("closedTime"), F.col("closed_time"))).alias("closed_ts"),
            outcome_pairs().alias("_pairs"),
            F.trim(text_or_null("groupItemTitle")).alias("bucket_label"),
            F.trim("groupItemThreshold").try_cast("int").alias("bucket_index"),
        )

    # generating the parsed row keeps the planner from working every pattern out a second time for the filter behind it
    known = raw.withColumn("_key", kind_of("question", kinds)).where("_key IS NOT NULL")
    df = known.select("*", F.explode(F.array(parsed(F.col("_key")))).alias("_row")).where("_row.timeframe IS NOT NULL AND _row.crypto IS NOT NULL AND _row.start_ts < _row.end_ts").select(*raw.columns, "_row.*")
    df = df.withColumn("slug", F.trim(text_or_null("slug"))).withColumn("event_slug", event_slug())
    winner = F.get(F.filter("tokens", lambda t: F.coalesce(t["winner"], F.lit(False))), F.lit(0))["outcome"]
    df = df.withColumn("_winner", F.trim(winner)).withColumn("_priced", price_resolution())
    up = down = won = category = None
    for k in kinds:
        at = F.col("_kind") == k.key
        u, d = (_side("_pairs", k.up), _side("_pairs", k.down, k.up)) if k.up else (F.lit(None), F.lit(None))
        by_flag = F.when(has_phrase("_winner", k.up), 1).when(has_phrase("_winner", k.down), 0) if k.up else F.when(F.get("_pairs", F.lit(0))["outcome"] == F.col("_winner"), 1).when(F.array_contains(F.transform("_pairs", lambda t: t["outcome"]), F.col("_winner")), 0)
        r = F.coalesce(by_flag, F.col("_priced")) if k.up else F.coalesce(F.col("_priced"), by_flag)
        up, down, won, category = ((F.when(at, v) if w is None else w.when(at, v)) for w, v in ((up, u), (down, d), (won, r), (category, F.lit(k.category))))
    df = df.select("*", up.alias("_up"), down.alias("_down"), won.cast("tinyint").alias("resolution"), category.alias("category"))
    binary = (F.size("_pairs") == 2) & F.col("_up").isNotNull() & F.col("_down").isNotNull()
    df = df.where(F.when(F.col("category") == "crypto", binary).otherwise(F.size("_pairs") > 0))
    return df.select(
        F.col("id").alias("market_id"),
        F.col("_kind").alias("market_type"),
        "question",
        "crypto",
        "timeframe",
        F.coalesce(F.col("volume").try_cast("float"), F.lit(0.0)).cast("float").alias("volume"),
        *"resolution start_ts end_ts closed_ts".split(),
        F.coalesce(text_or_null("conditionId"), F.col("condition_id")).alias("condition_id"),
        F.col("_up.token_id").alias("up_token_id"),
        F.col("_down.token_id").alias("down_token_id"),
        F.map_from_entries(F.transform(F.array_distinct("_pairs"), lambda t: F.struct(t["outcome"], t["token_id"]))).alias("tokens"),
        *"slug event_slug bucket_index bucket_label category".split(),
        F.coalesce("is_active", F.lit(False)).alias("is_active"),
    )


def token_dimension(markets: DataFrame) -> DataFrame:
    """(token_id, market_id, outcome, crypto, timeframe, category): one row per token of the normalised markets."""
    return markets.select("market_id", "crypto", "timeframe", "category", F.explode("tokens").alias("outcome", "token_id")).dropDuplicates(["token_id"])


def split_categories(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Crypto and culture rows; a row without a category is crypto."""
    category = F.coalesce(F.col("category"), F.lit("crypto")) if "category" in df.columns else F.lit("crypto")
    return df.where(category != "culture"), df.where(category == "culture")
