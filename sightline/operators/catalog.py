"""The source catalogue, owners' histories and the upkeep of stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import urls
from sightline.functions.columns import blank_to_null, strip
from sightline.operators.skew import salted_join, top_rows


def attribute_sources(links: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Adds ``source_domain``: the catalogue domain that contains the page's domain, smallest first.

    Containment is turned into equality: every substring of a catalogue domain becomes a key (a domain of
    length L has at most L(L+1)/2), so page domains meet it by an ordinary equi-join however large both
    sides are. Distinct page domains are looked up once.
    """
    page_domain = F.replace(F.lower(urls.host_of(F.col("url"))), F.lit("www."), F.lit(""))
    keyed = links.withColumn("_domain", page_domain)
    domain = F.lower("domain")
    parts = F.flatten(F.transform(
        F.sequence(F.lit(1), F.length(domain)),
        lambda i: F.transform(F.sequence(F.lit(1), F.length(domain) - i + 1), lambda n: F.substr(domain, i, n)),
    ))
    table = catalogue.filter(F.coalesce("domain", F.lit("")) != "").select(
        F.col("domain").alias("source_domain"), F.explode(F.array_distinct(parts)).alias("_domain")
    ).groupBy("_domain").agg(F.min("source_domain").alias("source_domain"))
    wanted = keyed.select("_domain").filter(F.col("_domain") != "").distinct()
    found = wanted.join(table, "_domain")
    return salted_join(keyed, found, ["_domain"], "left", spread=links.columns).drop("_domain")


def list_sources(
    sources: DataFrame, countries: DataFrame, country_id: str | None = None, category: str | None = None,
    verified: bool = False, active_only: bool = True,
) -> DataFrame:
    """Catalogue rows with their country attached, by name."""
    kept = sources.filter(F.col("is_active")) if active_only else sources
    if country_id:
        kept = kept.filter(F.col("country_id") == country_id)
    if category:
        kept = kept.filter(F.col("category") == category)
    if verified:
        kept = kept.filter(F.col("is_verified"))
    c = countries.select(F.col("id").alias("country_id"), F.struct("code", "name_ar", "name_en").alias("country"))
    return kept.join(c, "country_id", "left").orderBy("name", "id")


def list_countries(countries: DataFrame) -> DataFrame:
    return countries.filter(F.col("is_active")).orderBy("name_ar")


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The table after an idempotent upsert on ``key``, with ``action`` in added / updated / same / kept.

    A row counts as updated only when a field differs (null-safe). Columns the incoming side lacks keep
    their stored value. Count actions with ``groupBy("action").count()``.
    """
    fields = [c for c in incoming.columns if c != key]
    new = incoming.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_in"))
    both = current.withColumn("_have", F.lit(True)).join(new, key, "full")
    changed = F.lit(False)
    for c in fields:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_new_{c}"))
    action = (
        F.when(F.col("_in").isNull(), "kept").when(F.col("_have").isNull(), "added")
        .when(changed, "updated").otherwise("same")
    )
    return both.select(
        key,
        *[F.when(F.col("_in"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
          for c in current.columns if c != key],
        action.alias("action"),
    )


def with_country_ids(sources: DataFrame, countries: DataFrame) -> DataFrame:
    """Country codes of incoming sources resolved to ids; an unknown code gives null."""
    ids = countries.select(F.col("code").alias("country_code"), F.col("id").alias("country_id"))
    return sources.drop("country_id").join(ids, "country_code", "left").drop("country_code")


# ------------------------------------------------------------------------------- owners' histories

def owned(rows: DataFrame, owner: str, column: str = "user_id") -> DataFrame:
    """Rows of one owner only; every history read goes through this filter, which reaches the scan."""
    return rows.filter(F.col(column) == owner)


def may_read(owner: Column, reader: str, is_admin: bool = False) -> Column:
    """A row without owner is open; otherwise only its owner or an administrator reads it."""
    return F.lit(True) if is_admin else F.coalesce(owner == reader, F.lit(True))


def history_page(rows: DataFrame, owner: str, limit: int = 50, offset: int = 0, **equal) -> DataFrame:
    """One owner's rows, newest first: a top-n, never a full sort of the table."""
    kept = owned(rows, owner)
    for column, value in equal.items():
        kept = kept.filter(F.col(column) == value)
    return kept.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def history_pages(rows: DataFrame, limit: int = 50, offset: int = 0, owner: str = "user_id") -> DataFrame:
    """The same page for every owner at once, with ``total``, the number of the owner's rows."""
    last = offset + limit
    page = top_rows(rows, [owner], [F.desc("created_at"), F.desc("id")], last, "place").filter(F.col("place") > offset)
    totals = rows.groupBy(F.col(owner).alias("_owner")).agg(F.count(F.lit(1)).alias("total"))
    return page.join(totals, F.col(owner).eqNullSafe(F.col("_owner"))).drop("_owner")


def file_page(
    files: DataFrame, users: DataFrame, limit: int = 100, offset: int = 0,
    user_id: str | None = None, file_type: str | None = None,
) -> DataFrame:
    """All owners' files, newest first, with the owner's columns. The page is cut before the join."""
    kept = files
    if user_id:
        kept = kept.filter(F.col("user_id") == user_id)
    if file_type:
        kept = kept.filter(F.col("file_type") == file_type)
    page = kept.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)
    return page.join(users.select(F.col("id").alias("user_id"), F.struct("email", "name").alias("user")), "user_id", "left")


def add_keywords(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """New keywords: stripped, blanks refused, one per owner and text, none that is stored already."""
    tidy = incoming.withColumn("keyword", strip(F.col("keyword"))).filter(F.coalesce("keyword", F.lit("")) != "")
    first = tidy.groupBy("user_id", "keyword").agg(
        F.min_by(blank_to_null(strip(F.col("category"))), "pos").alias("category"), F.min("pos").alias("pos")
    )
    return first.join(stored.select("user_id", "keyword").distinct(), ["user_id", "keyword"], "left_anti")


def delete_cascade(
    parents: DataFrame, removed: DataFrame, children: Sequence[tuple[DataFrame, str, str]], key: str = "id",
) -> list[DataFrame]:
    """The tables left after removing parents. ``children``: ``(table, foreign key, own key)`` along a
    chain; each level loses the rows whose parent left."""
    gone = removed.select(F.col(key).alias("_gone")).distinct()
    out = [parents.join(gone, parents[key] == F.col("_gone"), "left_anti")]
    for table, foreign, own in children:
        out.append(table.join(gone, table[foreign] == F.col("_gone"), "left_anti"))
        gone = table.join(gone, table[foreign] == F.col("_gone"), "left_semi").select(F.col(own).alias("_gone")).distinct()
    return out


def soft_delete(sources: DataFrame, removed: DataFrame) -> DataFrame:
    """Removed sources stay, flagged inactive."""
    flags = removed.select("id").distinct().withColumn("_off", F.lit(True))
    return sources.join(flags, "id", "left").withColumn(
        "is_active", F.when(F.col("_off"), False).otherwise(F.col("is_active"))
    ).drop("_off")


def patch(rows: DataFrame, changes: DataFrame, texts: Sequence[str] = (), keep_blank: Sequence[str] = ()) -> DataFrame:
    """Sets only the fields present. ``changes``: ``id``, the new values and ``fields array<string>``
    naming those that were sent. Texts are stripped; an empty one becomes null unless kept blank."""
    named = [c for c in changes.columns if c not in ("id", "fields")]
    new = changes.select("id", "fields", *[F.col(c).alias(f"_new_{c}") for c in named])
    joined = rows.join(new, "id", "left")

    def value(c):
        v = F.col(f"_new_{c}")
        if c in keep_blank:
            return strip(v)
        return blank_to_null(strip(v)) if c in texts else v

    return joined.select(*[
        F.when(F.array_contains("fields", c), value(c)).otherwise(F.col(c)).alias(c) if c in named else F.col(c)
        for c in rows.columns
    ])


def toggle_active(users: DataFrame, requests: DataFrame) -> DataFrame:
    """Flips ``is_active`` of the named users; nobody can switch off their own account.
    ``requests``: ``user_id, asked_by``, one row per flip; an even number of flips cancels out."""
    flips = requests.filter(F.col("user_id") != F.col("asked_by")).groupBy(F.col("user_id").alias("id")).agg(
        (F.count(F.lit(1)) % 2 == 1).alias("_flip")
    )
    return users.join(flips, "id", "left").withColumn(
        "is_active", F.when(F.col("_flip"), ~F.col("is_active")).otherwise(F.col("is_active"))
    ).drop("_flip")


def add_counts(entities: DataFrame, happenings: DataFrame, key: str, counter: str) -> DataFrame:
    """Adds the number of new happenings (downloads, results) to an entity's counter."""
    n = happenings.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return entities.join(n, key, "left").withColumn(
        counter, F.coalesce(counter, F.lit(0)) + F.coalesce("_n", F.lit(0))
    ).drop("_n")
