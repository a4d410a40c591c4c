"""Feed readers: landed JSON payloads to postings, one spec per provider.

A landed row is (provider, board, page, validator, body). Payloads are parsed as VARIANT, so a
number is not taken for a string; each posting is checked alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions import vocab
from freshet.functions.scalars import parse_date, salary_range
from freshet.operators.places import split_offices
from freshet.session import cut

LANDED = "provider string, board string, page int, validator string, body string"
POSTING_COLUMNS = (
    "id", "title", "company", "location", "locations", "department", "hints", "url", "posted_at", "source", "salary", "is_remote",
)


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


NUMBERS = "^(?:TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def _is_type(found: Column, name: str) -> Column:
    """Whether a variant's schema text is of a JSON type."""
    if name == "NUMBER":
        return found.rlike(NUMBERS)
    return found == name if name in ("STRING", "BOOLEAN") else found.startswith(name)


def is_a(v: Column, name: str) -> Column:
    """False for another type, for null and for an absent value."""
    return F.coalesce(_is_type(F.schema_of_variant(v), name), F.lit(False))


def is_absent(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "VOID", F.lit(True))


@dataclass(frozen=True)
class Check:
    path: str
    type: str
    optional: bool = False

    def found(self, v: Column) -> Column:
        return F.schema_of_variant(at(v, f"$.{self.path}"))

    def reason(self, found: Column) -> Column:
        """Why a value of the found type fails; null when it does not. The type is named once: a filter that
        Spark moves below the types would look it up again for every use."""
        absent = "VOID" if self.optional else self.type
        if self.type == "NUMBER":
            fits = found.rlike(NUMBERS + "|^VOID$" if self.optional else NUMBERS)
        elif self.type in ("STRING", "BOOLEAN"):
            fits = found.isin(self.type, absent)
        else:
            fits = F.left(found, F.lit(len(self.type))).isin(self.type, absent)
        return F.when(~F.coalesce(fits, F.lit(self.optional)), F.lit(f"{self.path}: expected {self.type.lower()}"))


@dataclass(frozen=True)
class Provider:
    name: str
    envelope: str  # path of the posting array
    checks: tuple[Check, ...]
    fields: Callable[[Column, Column], dict[str, Column]]
    more_reasons: Callable[[Column], list[Column]] = lambda v: []
    envelope_checks: tuple[Check, ...] = ()
    envelope_optional: bool = False
    paged: bool = False
    # Helper columns that `more_reasons` and `fields` use; each step may use those before it.
    prepare: tuple[Callable[[Column], dict[str, Column]], ...] = ()

    @property
    def prefix(self) -> str:
        return vocab.PROVIDER_PREFIXES[self.name]


def _blank(c: Column) -> Column:
    return F.when(c != "", c)


def remote_first(place: Column) -> Column:
    """the word that place resolution looks for, before the place."""
    return F.concat_ws(" — ", F.lit("Remote"), place)


def _hint(c: Column) -> Column:
    return F.filter(F.array(_blank(c)), lambda h: h.isNotNull())


def _primary(raw: Column) -> dict[str, Column]:
    offices = split_offices(raw)
    return {"location": F.coalesce(F.try_element_at(offices, F.lit(1)), F.lit("")), "locations": offices}


# Custom-field names that hold the department or the pay.
DEPARTMENT_FIELD = r"(?i)department|categor|^area\b|team"
PAY_FIELD = r"(?i)pay|salary|compensation"
PAY_TYPE = r"currency|range"


FIELD = "struct<name:variant,value:variant,value_type:variant>"


def _text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _range_text(field: Column) -> Column:
    value = field["value"]
    money = at(value, "$.currency")
    numbers = is_a(at(value, "$.min"), "NUMBER") & is_a(at(value, "$.max"), "NUMBER")
    fine = numbers & (is_absent(money) | is_a(money, "STRING"))
    low, high = F.try_variant_get(value, "$.min", "double"), F.try_variant_get(value, "$.max", "double")
    return F.when(fine, salary_range(low, high, _text_of(money)))


def _first_field(name_pattern: str, type_pattern: str | None = None) -> Column:
    """F16: first custom field with a matching name (and type)."""
    def fits(field: Column) -> Column:
        named = _text_of(field["name"]).rlike(name_pattern)
        if type_pattern is None:
            return named
        return named & F.coalesce(_text_of(field["value_type"]), F.lit("")).rlike(type_pattern)

    return F.try_element_at(F.filter("_fields", fits), F.lit(1))


def _is_range(field: Column) -> Column:
    return F.coalesce(_text_of(field["value_type"]), F.lit("")) == "currency_range"


def _greenhouse_fields(v: Column) -> Column:
    return F.try_variant_get(v, "$.metadata", f"array<{FIELD}>")


def _greenhouse(v: Column, board: Column) -> dict[str, Column]:
    team, pay = F.col("_team"), F.col("_pay")
    team_text = F.when(_is_range(team), _range_text(team)).otherwise(_text_of(team["value"]))
    return {
        "external": text(v, "$.id"),
        "title": text(v, "$.title"),
        **_primary(text(v, "$.location.name")),
        "department": F.coalesce(team_text, F.lit("")),
        "url": text(v, "$.absolute_url"),
        "posted_at": parse_date(F.coalesce(text(v, "$.first_published"), text(v, "$.updated_at"))),
        "salary": F.coalesce(F.when(_is_range(pay), _range_text(pay)), F.lit("")),
    }


def _greenhouse_fields_ok(v: Column) -> list[Column]:
    fields = at(v, "$.metadata")

    def broken(field: Column) -> Column:
        value_type = field["value_type"]
        return field.isNull() | ~is_a(field["name"], "STRING") | ~(is_absent(value_type) | is_a(value_type, "STRING"))

    return [
        F.when(~is_absent(fields) & ~is_a(fields, "ARRAY"), F.lit("metadata: expected array")),
        F.when(F.exists("_fields", broken), F.lit("metadata: expected named fields")),
    ]


def _lever(v: Column, board: Column) -> dict[str, Column]:
    return {
        "external": text(v, "$.id"),
        "title": text(v, "$.text"),
        **_primary(F.coalesce(text(v, "$.categories.location"), F.lit(""))),
        "department": F.coalesce(text(v, "$.categories.department"), F.lit("")),
        "hints": _hint(text(v, "$.categories.team")),
        "url": text(v, "$.hostedUrl"),
        "posted_at": F.timestamp_millis(F.try_variant_get(v, "$.createdAt", "bigint")),
    }


def _ashby(v: Column, board: Column) -> dict[str, Column]:
    remote = F.coalesce(F.try_variant_get(v, "$.isRemote", "boolean"), F.lit(False))
    place = text(v, "$.location")
    said = F.lower(place).startswith("remote")
    return {
        "external": text(v, "$.id"),
        "title": text(v, "$.title"),
        **_primary(F.when(remote & ~said, F.concat(F.lit("Remote — "), place)).otherwise(place)),
        "department": F.coalesce(text(v, "$.department"), F.lit("")),
        "hints": _hint(text(v, "$.team")),
        "url": text(v, "$.jobUrl"),
        "posted_at": parse_date(text(v, "$.publishedAt")),
        "is_remote": remote,
    }


def _smartrecruiters(v: Column, board: Column) -> dict[str, Column]:
    remote = F.coalesce(F.try_variant_get(v, "$.location.remote", "boolean"), F.lit(False))
    place = _blank(text(v, "$.location.fullLocation"))
    return {
        "external": text(v, "$.id"),
        "title": text(v, "$.name"),
        **_primary(F.when(remote, remote_first(place)).otherwise(F.coalesce(place, F.lit("Unknown")))),
        "department": F.coalesce(text(v, "$.department.label"), F.lit("")),
        "hints": _hint(text(v, "$.function.label")),
        "url": F.concat(
            F.lit("https://careers.smartrecruiters.com/"), F.replace(F.url_encode(board), F.lit("+"), F.lit("%20")),
            F.lit("/"), text(v, "$.uuid"),
        ),
        "posted_at": parse_date(text(v, "$.releasedDate")),
        "is_remote": remote,
    }


def _workable(v: Column, board: Column) -> dict[str, Column]:
    def joined(city: Column, country: Column) -> Column:
        return F.concat_ws(", ", _blank(city), _blank(country))

    remote = F.coalesce(F.try_variant_get(v, "$.telecommuting", "boolean"), F.lit(False))
    place = joined(text(v, "$.city"), text(v, "$.country"))
    primary = F.when(remote, remote_first(_blank(place))).otherwise(place)
    listed = F.transform(
        F.coalesce(F.try_variant_get(v, "$.locations", "array<variant>"), F.array().cast("array<variant>")),
        lambda m: joined(text(m, "$.city"), text(m, "$.country")),
    )
    return {
        "external": text(v, "$.shortcode"),
        "title": text(v, "$.title"),
        "location": primary,
        "locations": F.concat(F.filter(listed, lambda p: p != ""), split_offices(primary)),  # U5
        "department": F.coalesce(text(v, "$.department"), F.lit("")),
        "url": F.coalesce(text(v, "$.url"), text(v, "$.shortlink"), F.lit("")),
        "posted_at": parse_date(F.coalesce(text(v, "$.published_on"), text(v, "$.created_at"))),
        "is_remote": remote,
    }


def _workable_dated(v: Column) -> list[Column]:
    date = F.coalesce(text(v, "$.published_on"), text(v, "$.created_at"), F.lit(""))
    return [F.when(date == "", F.lit("missing posting date"))]


def _label_ok(path: str) -> Callable[[Column], Column]:
    def check(v: Column) -> Column:
        label = F.schema_of_variant(at(v, f"$.{path}.label"))
        return F.when(label != "STRING", F.lit(f"{path}.label: expected string"))
    return check


# Adding a feed is one more entry here and its id prefix in the vocabulary.
PROVIDERS: dict[str, Provider] = {p.name: p for p in (
    Provider(
        "greenhouse", "$.jobs",
        (Check("id", "NUMBER"), Check("title", "STRING"), Check("location.name", "STRING"), Check("updated_at", "STRING"),
         Check("first_published", "STRING", True), Check("absolute_url", "STRING")),
        _greenhouse, _greenhouse_fields_ok,
        prepare=(
            lambda v: {"_fields": _greenhouse_fields(v)},
            lambda v: {"_team": _first_field(DEPARTMENT_FIELD), "_pay": _first_field(PAY_FIELD, PAY_TYPE)},
        ),
    ),
    Provider(
        "lever", "$",
        (Check("id", "STRING"), Check("text", "STRING"), Check("categories", "OBJECT"),
         Check("categories.department", "STRING", True), Check("categories.team", "STRING", True),
         Check("categories.location", "STRING", True), Check("createdAt", "NUMBER"), Check("hostedUrl", "STRING")),
        _lever,
    ),
    Provider(
        "ashby", "$.jobs",
        (Check("id", "STRING"), Check("title", "STRING"), Check("department", "STRING", True), Check("team", "STRING", True),
         Check("location", "STRING"), Check("publishedAt", "STRING"), Check("jobUrl", "STRING"), Check("isRemote", "BOOLEAN", True)),
        _ashby,
    ),
    Provider(
        "smartrecruiters", "$.content",
        (Check("id", "STRING"), Check("name", "STRING"), Check("uuid", "STRING"), Check("releasedDate", "STRING"),
         Check("company.identifier", "STRING"), Check("location", "OBJECT", True), Check("location.city", "STRING", True),
         Check("location.region", "STRING", True), Check("location.country", "STRING", True),
         Check("location.fullLocation", "STRING", True), Check("location.remote", "BOOLEAN", True),
         Check("department", "OBJECT"), Check("function", "OBJECT")),
        _smartrecruiters, lambda v: [_label_ok("department")(v), _label_ok("function")(v)],
        envelope_checks=(Check("totalFound", "NUMBER"),), paged=True,
    ),
    Provider(
        "workable", "$.jobs",
        (Check("title", "STRING"), Check("shortcode", "STRING"), Check("telecommuting", "BOOLEAN", True),
         Check("department", "STRING", True), Check("url", "STRING", True), Check("shortlink", "STRING", True),
         Check("published_on", "STRING", True), Check("created_at", "STRING", True), Check("country", "STRING", True),
         Check("city", "STRING", True), Check("locations", "ARRAY", True)),
        _workable, _workable_dated, envelope_optional=True,
    ),
)}


def provider(name: str) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider: {name}")
    return PROVIDERS[name]


def _items(spec: Provider) -> Column:
    return F.try_variant_get("v", spec.envelope, "array<variant>")


def _broken(spec: Provider) -> Column:
    # A cast tells an array or object from anything else without walking through its contents.
    broken = F.col("items").isNull()
    if spec.envelope_optional:
        is_object = F.try_variant_get("v", "$", "map<string,variant>").isNotNull()
        listed = at(F.col("v"), spec.envelope)
        broken = broken & ~(is_object & (listed.isNull() | F.is_variant_null(listed)))
    for check in spec.envelope_checks:
        broken = broken | check.reason(check.found(F.col("v"))).isNotNull()
    return broken


def open_pages(landed: DataFrame, names: Sequence[str] = tuple(PROVIDERS)) -> DataFrame:
    """The landed pages with their bodies parsed, once, and a flag for a broken envelope.

    Written as a table in folders by provider, so that every reader opens only its own pages and no
    body is parsed again: provider, board, page, validator, found (total of a paged feed), items, broken.
    """
    specs = [provider(n) for n in names]

    def by_provider(part: Callable[[Provider], Column]) -> Column:
        result = F.when(F.col("provider") == specs[0].name, part(specs[0]))
        for spec in specs[1:]:
            result = result.when(F.col("provider") == spec.name, part(spec))
        return result

    own = landed.filter(F.col("provider").isin(*names)).withColumn("v", F.try_parse_json("body"))
    whole = own.withColumn("items", by_provider(_items)).withColumn("broken", by_provider(_broken))
    found = F.try_variant_get("v", "$.totalFound", "double")
    return cut(whole.select("provider", "board", "page", "validator", found.alias("found"), "items", "broken"), "provider")


def pages(opened: DataFrame, spec: Provider) -> DataFrame:
    return opened.filter(F.col("provider") == spec.name)


def parsed(opened: DataFrame, spec: Provider) -> DataFrame:
    """Every posting of every page with the first reason it fails, if it does."""
    whole = pages(opened, spec).filter(~F.col("broken"))
    items = whole.select("provider", "board", "page", F.posexplode("items").alias("pos", "p"))
    p = F.col("p")
    for step in spec.prepare:
        items = items.select("*", *[c.alias(name) for name, c in step(p).items()])
    # The type of each field is its own column, so it is looked up once and not once per use.
    types = [c.found(p).alias(f"_k{i}") for i, c in enumerate(spec.checks)]
    reasons = [c.reason(F.col(f"_k{i}")) for i, c in enumerate(spec.checks)] + spec.more_reasons(p)
    return items.select("*", *types).select(*items.columns, F.coalesce(*reasons).alias("reason"))


def _postings(opened: DataFrame, spec: Provider) -> DataFrame:
    good = parsed(opened, spec).filter(F.col("reason").isNull())
    defaults = {
        "hints": F.array().cast("array<string>"), "salary": F.lit(""), "is_remote": F.lit(False),
    }
    fields = {**defaults, **spec.fields(F.col("p"), F.col("board"))}
    fields["id"] = F.concat_ws("-", F.lit(spec.prefix), F.col("board"), fields.pop("external"))
    fields["company"], fields["source"] = F.col("board"), F.lit(spec.name)
    return good.select("provider", "board", "page", "pos", *[fields[c].alias(c) for c in POSTING_COLUMNS])


def read_feeds(opened: DataFrame, names: Sequence[str] = tuple(PROVIDERS)) -> DataFrame:
    """Valid postings of opened pages; a board with one broken page is left out whole."""
    rows = reduce(DataFrame.unionByName, [_postings(opened, provider(n)) for n in names])
    failed = cut(opened.filter("broken").select("provider", "board").distinct())
    return rows.join(failed, ["provider", "board"], "left_anti")


def failed_boards(opened: DataFrame, name: str) -> DataFrame:
    return pages(opened, provider(name)).filter("broken").select("provider", "board").distinct()


def skip_summary(opened: DataFrame, name: str) -> DataFrame:
    """Skipped postings per board and the reason of the first one."""
    # Counted without a filter: Spark would move it below the reason and look every field up twice.
    rows = parsed(opened, provider(name))
    first = F.min_by("reason", F.when(F.col("reason").isNotNull(), F.struct("page", "pos")))
    return rows.groupBy("provider", "board").agg(F.count("reason").alias("skipped"), first.alias("reason")).filter("skipped > 0")


def completeness(opened: DataFrame, name: str) -> DataFrame:
    """A paged board is complete when a page reaches the total or comes back empty, and every page
    before that one is there and whole."""
    spec = provider(name)
    rows = pages(opened, spec).filter(~F.col("broken"))
    if not spec.paged:
        return rows.groupBy("provider", "board").agg(F.lit(True).alias("complete"))
    reached = (F.col("page") + 1) * vocab.SMARTRECRUITERS_PAGE >= F.col("found")
    once = rows.groupBy("provider", "board", "page").agg(F.bool_or(reached | (F.size("items") == 0)).alias("last"))
    ends = once.groupBy("provider", "board").agg(F.min(F.when(F.col("last"), F.col("page"))).alias("end"))
    before = F.count_if(F.col("page") <= F.col("end"))
    met = once.join(ends, ["provider", "board"]).groupBy("provider", "board", "end").agg(before.alias("n"))
    return met.select("provider", "board", F.coalesce(F.col("n") == F.col("end") + 1, F.lit(False)).alias("complete"))


def page_mark() -> Column:
    """What tells one version of a page from another: its validator, else the hash of its content."""
    return F.coalesce("validator", F.sha2("body", 256))


def changed_boards(landed: DataFrame, seen: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """All landed pages of every board that differs from what was seen last.

    A board has changed if any of its pages is new or has another mark, or if a page that was seen is
    gone. `seen` has provider, board, page and mark; `marks` the same of the landed pages, where they are known.
    """
    key = ["provider", "board", "page", "mark"]
    landed = landed.withColumn("mark", page_mark()) if marks is None else landed
    now = (landed if marks is None else marks).select(*key)
    fresh = now.join(seen.select(*key), key, "left_anti").select("provider", "board")
    gone = seen.select(*key).join(now, key, "left_anti").select("provider", "board")
    changed = cut(fresh.unionByName(gone).distinct())  # one row per board: bodies need not move to meet it
    return landed.join(changed, ["provider", "board"], "left_semi")
