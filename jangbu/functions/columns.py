"""Column expressions: flags, statuses, keys, text cleaning, dates. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell statuses by the operator that asks for them.
STATUS_SETS = {
    "present": ("value_present",),
    "absent": ("field_absent",),
    "external": ("external_reference",),
    "not_disclosed": ("not_disclosed",),
    "conflict": ("conflict",),
    "unresolved": ("extraction_failed", "review_required"),
}


def active(c: str = "active") -> Column:
    """Everything but the text ``false`` is active, null too."""
    return F.lower(F.coalesce(F.col(c).cast("string"), F.lit("true"))) != "false"


def flag(c: Column) -> Column:
    """``false``, ``0``, ``no`` and ``n`` are false, anything else, null too, is true."""
    return ~F.coalesce(F.lower(F.trim(c.cast("string"))), F.lit("true")).isin("false", "0", "no", "n")


def status_is(operator: str, c: str = "status", negated: bool = False) -> Column:
    """Whether a status belongs to an operator's set; null (no row) stays undetermined."""
    hit = F.col(c).isin(*STATUS_SETS[operator])
    return ~hit if negated else hit


def compare(value: Column, operator: str, literal: float) -> Column:
    """One of five comparisons, undetermined for null."""
    return {">=": value >= literal, "<=": value <= literal, ">": value > literal, "<": value < literal, "==": value == literal}[operator]


def plain_amount(c: Column) -> Column:
    """Won of an amount written in digits, null for any other notation."""
    return F.regexp_replace(F.when(c.rlike(r"^\s*[0-9][0-9,]*(\.[0-9]+)?\s*(원)?\s*$"), c), r"[,원\s]", "").cast("double")


def expression_key(c: Column) -> Column:
    """Letters, digits and Hangul only, lower case."""
    return F.lower(F.regexp_replace(c, r"[^0-9A-Za-z가-힣]", ""))


def compact(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s", ""))


def strip_enumerator(c: Column) -> Column:
    """Text without a leading list number or bullet."""
    return F.trim(F.regexp_replace(c, r"^\s*(?:[0-9]+[.)]|[가-하][.)]|[-○●■□◦▪※*•])\s*", ""))


def strip_label(c: Column) -> Column:
    """Text behind a short leading label and its colon."""
    return F.trim(F.regexp_replace(c, r"^[^:：0-9]{1,12}[:：]\s*", ""))


def strip_brackets(c: Column, depth: int = 3) -> Column:
    """Text without bracketed remarks, nested up to ``depth``."""
    for _ in range(depth):
        c = F.regexp_replace(c, r"\([^()]*\)|\[[^\[\]]*\]|<[^<>]*>|【[^【】]*】", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_markup(c: Column) -> Column:
    """Text of a table or of markdown: no tags, table rules, headings or emphasis, single blanks."""
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    c = F.regexp_replace(c, r"\|", " ")
    c = F.regexp_replace(c, r"(-{3,}|[#*`])", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def display(value: Column, raw: Column) -> Column:
    """Normalised value if there is one, else the raw text, trimmed; null if both are empty."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.nullif(F.trim(raw), F.lit("")))


def redact(c: Column) -> Column:
    """Mail addresses, telephone and resident numbers masked, in this order."""
    c = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[mail]")
    c = F.regexp_replace(c, r"[0-9]{6}-[1-4][0-9]{6}", "[id]")
    return F.regexp_replace(c, r"0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}", "[phone]")


def loose_date(c: Column) -> Column:
    """``yyyy-MM-dd`` of the first year-month-day in a text whose parts are in range, else null."""
    rx = r"((?:19|20)[0-9]{2})[-./년 ]+([0-9]{1,2})[-./월 ]+([0-9]{1,2})"
    y, m, d = (F.regexp_extract(c, rx, i) for i in (1, 2, 3))
    fits = m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31)
    return F.when((y != "") & fits, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def amount_conditions(c: Column) -> Column:
    """Condition words of an amount, joined with ``,`` in a fixed order."""
    return F.concat_ws(",", *(F.when(c.contains(w), F.lit(w)) for w in ("이내", "이상", "이하", "초과", "미만", "VAT")))


def section(path: Column) -> Column:
    """Path of headings as one text; null and empty parts are skipped."""
    return F.array_join(F.filter(path, lambda x: x.isNotNull() & (x != "")), " > ")


def ordinal(chunk_id: Column) -> Column:
    """Number at the end of a chunk's id, null if it ends in none."""
    return F.regexp_extract(chunk_id, r"-([0-9]+)$", 1).try_cast("int")


def region_restriction(text: Column) -> Column:
    """``restricted``, ``none`` or ``unknown``; wordings that restrict come first."""
    return (
        F.when(text.rlike(r"본점|본사|소재지|소재한|권역|관내|지역\s*업체|지역\s*의무"), "restricted").when(text.rlike(r"제한\s*(없|하지)|전국|무관|해당\s*없"), "none").otherwise("unknown")
    )


def response_kind(text: Column) -> Column:
    """What a response is: clarification, abstention, refusal or answer, in this order."""
    return (
        F.when(text.rlike(r"어느|무엇을 말씀|구체적으로|확인 부탁"), "clarification").when(text.rlike(r"찾을 수 없|확인이 필요|확인되지|알 수 없"), "abstention").when(text.rlike(r"답변드릴 수 없|할 수 없습니다|불가합니다"), "refusal").otherwise("answer")
    )


def masked_secrets(c: Column) -> Column:
    """An error text without keys, mail addresses and telephone numbers."""
    c = F.regexp_replace(c, r"(?:sk|pk|key|token)[-_][A-Za-z0-9]{8,}", "[secret]")
    c = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[mail]")
    return F.regexp_replace(c, r"0[0-9]{1,2}-?[0-9]{3,4}-?[0-9]{4}", "[phone]")


def bounded(text: Column, item: Column) -> Column:
    """Whether an item stands in a text between a blank or the beginning and a blank, a particle or the end; blank items stand nowhere."""
    ending = r"(?:은|는|이|가|을|를|의|에|로|으로|와|과|도|만|입니다|이다)?(?:\s|[,.]|$)"
    rx = F.concat(F.lit(r"(?:^|\s)\Q"), F.trim(item), F.lit(rf"\E{ending}"))
    return (F.trim(item) != "") & F.regexp_like(text, rx)


def without_part(c: Column) -> Column:
    """A location label without the part it ends in, ``(2/3)``."""
    return F.trim(F.regexp_replace(c, r"\s*\(\d+/\d+\)\s*$", ""))


def common_prefix(a: Column, b: Column) -> Column:
    """The elements two paths begin with in common; null where either is null."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.try_element_at(a, i).eqNullSafe(F.try_element_at(b, i)))
    upto = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, x: F.struct(F.when(acc["on"] & x, acc["n"] + 1).otherwise(acc["n"]).alias("n"), (acc["on"] & x).alias("on")))["n"]
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(n <= 0, F.slice(a, 1, 0)).otherwise(F.slice(a, 1, upto))


def location_of(path: Column, label: Column) -> Column:
    """Section, reference and paragraph of a chunk: the leaf of its path, else what its label begins with; the label without its part; the first paragraph number in it."""
    leaf = F.try_element_at(F.filter(path, lambda x: x.isNotNull() & (x != "")), F.lit(-1))
    plain = without_part(label)
    return F.struct(F.coalesce(leaf, F.nullif(F.trim(F.regexp_extract(label, r"^([^·\d]+)", 1)), F.lit(""))).alias("section"), plain.alias("ref_no"), F.regexp_extract(label, r"(\d+)", 1).try_cast("int").alias("number"))


def canonical_json(value: Column) -> Column:
    """JSON text with its members in order of name and without blanks: equal content, equal text; null for what is no JSON."""
    return F.to_json(F.try_parse_json(value))


def points_per_item(n: Column) -> Column:
    """Points of a hundred that one of ``n`` items is worth, null for none."""
    return F.round(F.lit(100.0) / F.nullif(n, F.lit(0)), 4)


def as_array(c: Column) -> Column:
    """A list of ids from a JSON array, a single id, or nothing; blank ids are none."""
    listed = F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>"))
    one = F.when(~F.trim(c).startswith("[") & (F.trim(c) != ""), F.array(F.trim(c)))
    return F.filter(F.coalesce(listed, one, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))
