"""Mixed timestamp notations brought to one UTC instant.

An ordered cascade of anchored patterns rewrites a text to one canonical
notation, which is then parsed strictly (a 30 February is no date).  The zone is
the one stated, else the source's home zone from the lookup table.  Everything
is a column expression; nothing leaves the JVM.

Local times a zone has twice or not at all follow an explicit policy:
``"standard"`` takes the first of two (the offset before the change) and moves
a skipped one forward by the gap; ``"later"`` takes the second of two; ``"null"``
refuses both kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jangbu.runtime import cut

POLICIES = ("standard", "later", "null")

# Abbreviations and spellings of zones.
ABBREVIATIONS = {
    "Z": "UTC", "UTC": "UTC", "GMT": "UTC", "KST": "+09:00", "JST": "+09:00", "CET": "+01:00", "CEST": "+02:00", "MEZ": "+01:00", "MESZ": "+02:00", "BST": "+01:00", "WET": "UTC", "EET": "+02:00", "EEST": "+03:00",
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
    "한국시간": "Asia/Seoul", "한국표준시": "Asia/Seoul", "서울시각": "Asia/Seoul", "서울시간": "Asia/Seoul", "한국시각": "Asia/Seoul",
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_NAMES = "|".join(sorted((a for a in ABBREVIATIONS if a.isascii()), key=len, reverse=True))
_KOREAN = r"한국\s?(?:시간|시각|표준시)|서울\s?(?:시각|시간)"
#: A zone after a time, or in front of everything; group 1 is an offset, 2 a name.
ZONE_AFTER = rf"(?:(?<=:\d\d|[.,]\d{{1,9}}|T\d{{4}}|T\d{{6}}|시|분|[AaPp][Mm])\s?[(\[]?(?:UTC|GMT)?\s?([+\-−]\d{{1,2}}(?::?\d{{2}})?)[)\]]?|\s?[(\[]?({_KOREAN}|[A-Z][A-Za-z]+/[A-Za-z_]+(?:/[A-Za-z_]+)?|(?<![A-Za-z])(?:{_NAMES}))[)\]]?)$"
ZONE_BEFORE = rf"^[(\[]?({_NAMES}|{_KOREAN})[)\]]?\s+(?=\S)"

_AP = r"오전|오후|[AaPp]\.?[Mm]\.?"
_TIME = rf"(?:(?:\s*[T,]\s*|\s+|(?<=[일)])\s*)({_AP})?\s*(\d{{1,2}})(?::(\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,9}}))?)?|시(?:\s*(\d{{1,2}})분(?:\s*(\d{{1,2}})초)?)?)\s*({_AP})?(?:\s*Uhr)?)?"
_DAY = r"(?:\s*\((?:[월화수목금토일]|[A-Za-z]{2,3})(?:요일)?\))?"
_WEEKDAY = r"(?:(?:[Mm]on|[Tt]ue|[Ww]ed|[Tt]hu|[Ff]ri|[Ss]at|[Ss]un|Mo|Di|Mi|Do|Fr|Sa|So)[a-z]*\.?,?\s+)?"

#: Name of the field order, anchored pattern whose first three groups are the date's parts and the next eight the time's.
CASCADE = (
    ("ymd", rf"^(\d{{4}})\s?년\s*(\d{{1,2}})\s?월\s*(\d{{1,2}})\s?일{_DAY}{_TIME}$"),
    ("ymd", rf"^(\d{{4}})\s*[-/.]\s*(\d{{1,2}})\s*[-/.]\s*(\d{{1,2}})\.?{_DAY}{_TIME}$"),
    ("xxy", rf"^{_WEEKDAY}(\d{{1,2}})\s*[-/.]\s*(\d{{1,2}})\s*[-/.]\s*(\d{{4}})\.?{_DAY}{_TIME}$"),
    ("xxx", rf"^'?(\d{{2}})\s*[-/.]\s*(\d{{1,2}})\s*[-/.]\s*(\d{{2}})\.?{_DAY}{_TIME}$"),
    ("ymd2", rf"^'?(\d{{2}})\s?년\s*(\d{{1,2}})\s?월\s*(\d{{1,2}})\s?일{_DAY}{_TIME}$"),
    ("dmy", rf"^{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th|\.)?[\s\-]+([A-Za-z]{{3,9}})\.?,?[\s\-]+(\d{{4}}){_TIME}$"),
    ("mdy", rf"^{_WEEKDAY}([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_TIME}$"),
    ("ymd", r"^(\d{4})(\d{2})(\d{2})(?:[T\s]?()(\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?()()())?$"),
)
_WIDE = "０１２３４５６７８９：．／－＋，　   −"
_NARROW = "0123456789:./-+,    -"


def zones(spark: SparkSession) -> DataFrame:
    """``zone_name, zone_id``: abbreviations and every IANA name the JVM knows (some 650 rows, fixed)."""
    known = sorted(z for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in z and not z.startswith(("Etc/", "SystemV/")))
    return spark.createDataFrame([*ABBREVIATIONS.items(), *((z, z) for z in known)], "zone_name string, zone_id string")


def _parts(body: Column) -> Column:
    """``order|a|b|c|ap|h|mi|s|frac|mi2|s2|ap2`` of the first pattern that matches, else null.

    Each pattern is tried once: what one has rewritten begins with a character no
    text has and no later pattern allows, so the rest fail on it at once.
    """
    out = body
    for order, rx in CASCADE:
        out = F.regexp_replace(out, rx, "\x01" + order + "".join(f"|${i}" for i in range(1, 12)))
    return F.nullif(F.regexp_extract(out, "^\x01(.*)$", 1), F.lit(""))


def instants(records: DataFrame, text: str, systems: DataFrame, policy: str = "standard", system: str = "collection_system") -> DataFrame:
    """``records`` with ``instant`` (TIMESTAMP_NTZ, UTC) of column ``text`` and ``time_issue``.

    ``systems`` has one row per ``collection_system`` with ``home_zone`` and
    ``date_order``.  ``instant`` is null for null, empty and unreadable texts,
    impossible dates, unknown zones, and texts without a zone whose system is
    null or unknown (an epoch number or a stated zone needs none); a date order
    that is not known reads as ymd with a two-digit year, dmy with a four-digit one.
    Columns of these two names that the records already have are replaced.
    ``time_issue`` is ``ambiguous`` or ``nonexistent`` where the policy decided.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy {policy!r} is none of {POLICIES}")
    keep = [c for c in records.columns if c not in ("instant", "time_issue")]
    known = systems.select(F.col("collection_system").alias("_sys"), F.col("home_zone").alias("_home"), F.col("date_order").alias("_order")).dropDuplicates(["_sys"])
    t = F.trim(F.regexp_replace(F.translate(F.col("_text"), _WIDE, _NARROW), r"\s+", " "))
    # whatever columns come along travel in a struct, so that no name of theirs meets one used here
    packed = records.select(F.struct(*keep).alias("_r"), F.col(text).alias("_text"), F.col(system).alias("_system"))
    df = packed.join(F.broadcast(known), F.col("_system") == F.col("_sys"), "left").withColumn("_t", t)
    before = F.regexp_extract("_t", ZONE_BEFORE, 1)
    df = df.withColumn("_front", before).withColumn("_t", F.when(before != "", F.regexp_replace("_t", ZONE_BEFORE, "")).otherwise(F.col("_t")))
    # one pass: body, offset and name of a zone after it, parted by a character no text has
    df = df.withColumn("_z", F.split(F.regexp_replace(F.translate("_t", "\x01", " "), ZONE_AFTER, "\x01$1\x01$2"), "\x01", -1))
    part = lambda i: F.coalesce(F.get("_z", F.lit(i)), F.lit(""))
    df = df.withColumns({"_offset": F.translate(part(1), "−", "-"), "_back": part(2), "_body": F.when(F.col("_t").isNotNull(), F.trim(part(0)))})
    df = df.withColumn("_name", F.regexp_replace(F.when(F.col("_back") != "", F.col("_back")).otherwise(F.col("_front")), r"\s", ""))
    z = zones(records.sparkSession).select(F.col("zone_name").alias("_zn"), F.col("zone_id").alias("_zi"))
    df = df.join(F.broadcast(z), F.col("_name") == F.col("_zn"), "left")
    sign, digits = F.substring("_offset", 1, 1), F.regexp_replace("_offset", r"[^\d]", "")
    hh = F.when(F.length(digits) <= 2, F.lpad(digits, 2, "0")).otherwise(F.lpad(F.expr("left(regexp_replace(_offset, '[^0-9]', ''), length(regexp_replace(_offset, '[^0-9]', '')) - 2)"), 2, "0"))
    mm = F.when(F.length(digits) <= 2, F.lit("00")).otherwise(F.expr("right(regexp_replace(_offset, '[^0-9]', ''), 2)"))
    offset = F.when(hh.cast("int").between(0, 14) & mm.cast("int").between(0, 59), F.concat(sign, hh, F.lit(":"), mm))
    df = df.withColumn("_zone", F.when(F.col("_offset") != "", offset).when(F.col("_name") != "", F.col("_zi")).otherwise(F.col("_home")))
    # a generator keeps the planner from copying the cascade into everything that reads its result
    df = df.withColumn("_p", F.explode_outer(F.array(F.split(_parts(F.col("_body")), r"\|", -1))))
    p = lambda i: F.nullif(F.get(F.col("_p"), F.lit(i)), F.lit(""))
    order = F.when(p(0) == "xxy", F.when(F.col("_order") == "mdy", "mdy").otherwise("dmy")).when(p(0) == "xxx", F.coalesce("_order", F.lit("ymd"))).when(p(0) == "ymd2", F.lit("ymd")).otherwise(p(0))
    df = df.withColumn("_o", order)
    pick = lambda c: F.when(F.substring("_o", 1, 1) == c, p(1)).when(F.substring("_o", 2, 1) == c, p(2)).otherwise(p(3))
    year = F.expr("try_cast(_y as int)") + F.when(F.length("_y") == 2, 2000).otherwise(0)
    named = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring("_m", 1, 3))), F.lit(0))
    month = F.when(F.col("_m").rlike("^[A-Za-z]"), named.cast("int")).otherwise(F.expr("try_cast(_m as int)"))
    ap = F.lower(F.regexp_replace(F.coalesce(p(4), p(11)), r"\.", ""))
    h = F.coalesce(p(5).cast("int"), F.lit(0))
    hour = F.when(ap.isin("오후", "pm"), F.when(h == 12, 12).when(h < 12, h + 12).when(h < 24, h)).when(ap.isin("오전", "am"), F.when(h <= 12, h % 12)).otherwise(h)
    minute = F.coalesce(p(6), p(9), F.lit("0")).cast("int")
    second = F.concat(F.coalesce(p(7), p(10), F.lit("0")), F.lit("."), F.substring(F.coalesce(p(8), F.lit("0")), 1, 6)).cast("decimal(16,6)")
    df = df.withColumns({"_y": pick("y"), "_m": pick("m"), "_d": pick("d").cast("int"), "_h": hour, "_mi": minute, "_s": second}).withColumns({"_y": year, "_m": month})
    midnight = (F.col("_h") == 24) & (F.col("_mi") == 0) & (F.col("_s") == 0)
    made = F.expr("try_make_timestamp_ntz(_y, _m, _d, if(_h = 24 and _mi = 0 and _s = 0, 0, _h), _mi, _s)")
    df = df.withColumn("_local", F.when(F.col("_h").between(0, 24) & (F.col("_s") < 60) & ((F.col("_h") < 24) | midnight), made + F.when(midnight, F.expr("interval 1 day")).otherwise(F.expr("interval 0 day"))))
    df = df.withColumn("_u", F.expr("convert_timezone(_zone, 'UTC', _local)"))
    # how far the zone's clock goes back within a day around: an hour nearly everywhere, but not everywhere
    df = df.withColumn("_back_by", F.expr("convert_timezone('UTC', _zone, _u - interval 1 day) - convert_timezone('UTC', _zone, _u + interval 1 day) + interval 2 days"))
    df = df.withColumn("time_issue", F.expr("case when convert_timezone('UTC', _zone, _u) <> _local then 'nonexistent' when _back_by > interval 0 seconds and convert_timezone('UTC', _zone, _u + _back_by) = _local then 'ambiguous' end"))
    if policy == "later":
        df = df.withColumn("_u", F.expr("if(time_issue = 'ambiguous', _u + _back_by, _u)"))
    elif policy == "null":
        df = df.withColumn("_u", F.expr("if(time_issue is null, _u, null)"))
    epoch = F.when(F.col("_t").rlike(r"^\d{10}$"), F.col("_t").cast("long") * 1_000_000).when(F.col("_t").rlike(r"^\d{13}$"), F.col("_t").cast("long") * 1000)
    df = df.withColumn("_us", epoch).withColumn("instant", F.expr("coalesce(timestampadd(MICROSECOND, _us, timestamp_ntz'1970-01-01 00:00:00'), _u)"))
    done = df.select("_r", F.explode_outer(F.array(F.struct(F.col("instant"), F.when(F.col("_us").isNull(), F.col("time_issue")).alias("time_issue")))).alias("_t"))
    return done.select("_r.*", "_t.instant", "_t.time_issue")


FIELDS = ("bid_deadline_raw", "notice_date")


def normalised(identity_records: DataFrame, systems: DataFrame, policy: str = "standard") -> DataFrame:
    """``record_id, document_id, field_name, raw, instant, time_issue`` of both time fields of every record."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw")) for f in FIELDS))).alias("f")
    long = identity_records.select("record_id", "document_id", "collection_system", each).select("record_id", "document_id", "collection_system", "f.field_name", "f.raw")
    return instants(long, "raw", systems, policy).select("record_id", "document_id", "field_name", "raw", "instant", "time_issue")


def same_instant_pairs(identity_records: DataFrame, systems: DataFrame) -> DataFrame:
    """``field_name, record_a, record_b``: records of one document whose differing texts denote one instant.

    Null documents and texts without an instant pair with nothing.  A document
    with very many records spreads over the instants its texts denote, and the
    planner's skew join splits what still is too large.
    """
    n = cut(normalised(identity_records, systems).where("document_id is not null and instant is not null").select("field_name", "document_id", "instant", "raw", "record_id"))
    a, b = n.alias("a"), n.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("field_name", "document_id", "instant")]
    pairs = a.join(b, on).where("a.record_id < b.record_id and a.raw <> b.raw")
    return pairs.select("a.field_name", F.col("a.record_id").alias("record_a"), F.col("b.record_id").alias("record_b"))
