"""Metadata records, identifiers and the reconciliation of local records, a registry and web pages.

The three sources are DataFrames joined by the upper-cased identifier. A source can be not asked, not found or found;
``registry_state`` and ``html_state`` keep these three apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.sources.transcripts import once

#: Metadata keys by how repeated values are read.
FIRST_WINS = ["Title", "Date", "Language", "Description", "Country", "Publisher", "Type"]
APPENDED = ["Creator", "Subject", "Contributor"]
LAST_WINS = ["DOI", "CMDI_PID"]


def doi(value: Column) -> Column:
    """SCF-14: the identifier in ``value`` (an optional doi: before it), or null: 10.digits, a slash, and a suffix."""
    bare = F.trim(F.regexp_replace(F.trim(value), r"^(doi:|DOI:)", ""))
    return F.when(bare.rlike(r"^10\.[0-9.]+/.+$"), bare)


def doi_forms(identifier: Column) -> Column:
    """SCF-14: struct<resolve_url, scheme, key> of an identifier: where it resolves, as doi:..., and in capitals, to compare by; null of null."""
    form = F.struct(F.concat(F.lit("https://doi.org/"), identifier).alias("resolve_url"), F.concat(F.lit("doi:"), identifier).alias("scheme"), F.upper(identifier).alias("key"))
    return F.when(identifier.isNotNull(), form)


def doi_state(state: Column) -> Column:
    """SCF-14: struct<retire_event, can_delete, indexed> of a registry state: only what is findable is hidden to retire it, only a
    draft can be deleted."""
    s = F.lower(state)
    return F.struct(F.when(s == "findable", "hide").alias("retire_event"), F.coalesce(s == "draft", F.lit(False)).alias("can_delete"), F.coalesce(s == "findable", F.lit(False)).alias("indexed"))


#: Beginnings of keys with a vocabulary, the column they go to, and whether the first, the last or all of them count.
OLAC = [
    ("Subject.olac:linguistic-field", "linguistic_field", "last"), ("Subject.olac:discourse-type", "discourse_type", "first"), ("Type.olac:discourse-type", "discourse_type", "first"),
    ("Type.olac:linguistic-type", "linguistic_type", "last"), ("Subject.olac:language", "languages", "all"),
]


def record(rows: DataFrame) -> DataFrame:
    """SRC-13, with the olac fields: (file, line, text) of ``Key:<tabs>value`` lines as one record a file."""
    # a key ends at the first colon, but for those of a vocabulary, which hold one
    field = r"^((?:Subject|Type)\.olac:[^:\t]+|[^:\t]+):\s*(.*)$"
    kv = once(rows.select("file", "line", "text"), *(F.trim(F.regexp_extract("text", field, k)).alias(c) for k, c in ((1, "key"), (2, "value")))).where("key <> '' and value <> ''")
    # a file's lines are gathered once, those of no field left out, and each field is looked up in them
    is_imdi = F.col("key").startswith("IMDI_")
    known = F.col("key").isin(*FIRST_WINS, *APPENDED, *LAST_WINS) | reduce(lambda a, b: a | b, [F.col("key").startswith(k) for k, _, _ in OLAC])
    kv = kv.select("file", F.when(known, F.struct("line", "key", "value")).alias("known"), F.when(is_imdi, F.struct("line", F.substr("key", F.lit(6)).alias("k"), "value")).alias("other"))
    imdi = F.transform(F.sort_array(F.collect_list("other")), lambda x: F.struct(x.k.alias("key"), x.value.alias("value"))).alias("imdi")
    r = kv.groupBy("file").agg(F.sort_array(F.collect_list("known")).alias("held"), imdi)
    lines = lambda on: F.filter("held", lambda x: on(x.key))
    how = {"first": lambda on: F.get(lines(on), F.lit(0)).value, "last": lambda on: F.try_element_at(lines(on), F.lit(-1)).value, "all": lambda on: F.transform(lines(on), lambda x: x.value)}
    same = lambda k: lambda key: key == k
    begins = lambda name: lambda key: reduce(lambda a, b: a | b, [key.startswith(k) for k, n, _ in OLAC if n == name])
    named = [(k.lower(), "first", same(k)) for k in FIRST_WINS] + [(f"{k.lower()}s", "all", same(k)) for k in APPENDED] + [(k.lower(), "last", same(k)) for k in LAST_WINS]
    olac = [(f"olac_{name}", way, begins(name)) for name, way in {n: w for _, n, w in OLAC}.items()]
    column = lambda c, way, on: (F.trim(F.regexp_replace(how[way](on), "^doi:", "")) if c == "doi" else how[way](on)).alias(c)
    out = [column(*x) for x in named + olac]
    return r.select("file", *out[: len(named)], "imdi", *out[len(named) :])


def year(date: Column) -> Column:
    """SCF-18."""
    return F.regexp_extract(date, r"^(\d+)", 1).try_cast("int")


def first_problem(r: DataFrame) -> DataFrame:
    """FLT-09, FLT-10: the first required field that is missing, and which recommended ones are."""
    required = F.when(F.col("title").isNull(), "Title").when(F.size("creators") == 0, "Creator").when(F.col("date").isNull(), "Date")
    sparse = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in ("language", "description", "country"))))
    return r.withColumns({"missing": required, "sparse": sparse})


def duplicates(records: DataFrame) -> DataFrame:
    """JON-16, AGG-22: identifiers (doi, repository) as they are written that several records have, and in how many repositories."""
    one = records.where("doi is not null").groupBy("doi", "repository").agg(F.count("*").alias("n"))
    return one.groupBy("doi").agg(F.sum("n").alias("n"), F.count("*").alias("repositories")).where("n > 1")


def html_identifiers(rows: DataFrame, prefix: str = "10.21415") -> DataFrame:
    """SRC-14: the first ``doi:prefix/...`` of each line (path, text), valid ones only; by key the smallest path wins."""
    found = doi(F.regexp_extract("text", rf"""(doi:{prefix.replace(".", "[.]")}/[^\s<"']*)""", 1))
    return rows.select("path", found.alias("doi")).where("doi is not null").groupBy(F.upper("doi").alias("key")).agg(F.min("path").alias("path"), F.min_by("doi", "path").alias("doi"))


def reconcile(local: DataFrame, registry: DataFrame | None = None, html: DataFrame | None = None) -> DataFrame:
    """JON-01 to JON-04, SET-06, AGG-23, SCF-16: the entries of all sources with their status.

    ``local``: path, doi, target_url, description, language, and title and bank if it has them. ``registry``: doi, state, url, and title
    if it has it. ``html``: key, path, doi.
    """
    key = F.upper("doi")
    known = lambda df, c: (F.col(c) if c in df.columns else F.lit(None).cast("string"))
    e = local.select("path", "doi", "target_url", "description", "language", known(local, "title").alias("title"), known(local, "bank").alias("bank"), key.alias("key"))
    # records without identifier are not gathered anywhere
    several = e.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("duplicate"))
    e = e.join(several, "key", "left").select("path", "doi", "target_url", "description", "language", "title", "bank", "key", F.coalesce("duplicate", F.lit(False)).alias("duplicate"))
    if registry is not None:
        r = registry.select(F.upper("doi").alias("r_key"), F.col("doi").alias("r_doi"), F.lower("state").alias("r_state"), F.col("url").alias("r_url"), known(registry, "title").alias("r_title"))
        j = e.join(r, (F.col("key") == F.col("r_key")) & ~F.col("duplicate"), "left")
        asked = F.when(F.col("key").isNull() | F.col("duplicate"), "not asked").when(F.col("r_key").isNull(), "not found").otherwise("found")
        orphans = r.join(e, F.col("r_key") == F.col("key"), "left_anti").withColumns({"key": F.col("r_key"), "registry_state": F.lit("found"), "duplicate": F.lit(False)})
        e = j.withColumn("registry_state", asked).unionByName(orphans, allowMissingColumns=True)
    else:
        e = e.withColumns({"r_doi": F.lit(None).cast("string"), "r_state": F.lit(None).cast("string"), "r_url": F.lit(None).cast("string"), "r_title": F.lit(None).cast("string"), "registry_state": F.lit("not asked")})
    e = e.drop("r_key")
    if html is not None:
        h = html.select(F.col("key").alias("h_key"), F.col("path").alias("h_path"), F.col("doi").alias("h_doi"))
        own = F.when(F.col("doi").isNotNull(), F.col("key"))
        j = e.withColumn("own", own).join(h, F.col("own") == F.col("h_key"), "left")
        state = F.when(F.col("doi").isNull(), "not asked").when(F.col("h_key").isNull(), "not found").otherwise("found")
        orphans = h.join(e.where("key is not null"), F.col("h_key") == F.col("key"), "left_anti").withColumns({"key": F.col("h_key"), "html_state": F.lit("found"), "registry_state": F.lit("not asked" if registry is None else "not found"), "duplicate": F.lit(False)})
        e = j.drop("own").withColumn("html_state", state).unionByName(orphans, allowMissingColumns=True).drop("h_key")
    else:
        e = e.withColumns({"h_path": F.lit(None).cast("string"), "h_doi": F.lit(None).cast("string"), "html_state": F.lit("not asked")})
    return e.withColumn("status", status())


def status() -> Column:
    """SCF-16: duplicates first, then the first of these that holds."""
    c = F.col
    has, found = c("doi").isNotNull(), c("registry_state") == "found"
    return (
        F.when(c("duplicate"), "DUPLICATE").when(found & (c("r_state") == "draft"), "DRAFT")
        .when(found & (c("r_url") != "") & (c("target_url") != c("r_url")), "URL MISMATCH").when(found & ~has, "MANUAL MINT")
        .when((c("html_state") == "found") & ~has & ~found, "HTML ONLY").when(has & (c("registry_state") == "not found"), "UNREGISTERED")
        .when(has & (c("html_state") == "not found"), "HTML STALE").when(~has, "NEEDS DOI").when(c("description").isNull() | c("language").isNull(), "INCOMPLETE").otherwise("OK")
    )


def suspicious(entries: DataFrame) -> DataFrame:
    """FLT-11."""
    return entries.where(~F.col("status").isin("OK", "INCOMPLETE"))


def payload(r: DataFrame) -> DataFrame:
    """SCF-15: a registry record as JSON; empty lists and nulls are left out."""
    listed = lambda c, f: F.when(F.size(c) > 0, F.transform(c, f))
    body = F.struct(
        F.col("doi"), listed("creators", lambda x: F.struct(x.alias("name"))).alias("creators"), F.array(F.struct(F.col("title").alias("title"))).alias("titles"),
        F.coalesce("publisher", F.lit("unknown")).alias("publisher"), year(F.col("date")).alias("publicationYear"), listed("subjects", lambda x: F.struct(x.alias("subject"))).alias("subjects"), "language",
    )
    return r.withColumn("payload", F.to_json(F.struct(F.struct(F.lit("dois").alias("type"), body.alias("attributes")).alias("data"))))


def target_url(path: Column, host: str, root: str, domains: dict[str, str] | None = None) -> Column:
    """SCF-17: the landing page of a record at repository/corpus/.../file, or null at the top. domains: repository -> bank;
    a bank is a part of ``host``, the bank ``root`` is ``host`` itself."""
    parts = F.split(path, "/")
    repo = F.get(parts, F.lit(0))
    bank = F.coalesce(*(F.when(repo == r, F.lit(b)) for r, b in (domains or {}).items()), repo)
    place = F.when(bank == root, F.lit(host)).otherwise(F.concat(bank, F.lit(f".{host}")))
    return F.when(F.size(parts) > 2, F.concat(F.lit("https://"), place, F.lit("/access/"), F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 2), "/"), F.lit(".html")))


def exported(r: DataFrame, host: str, root: str, publisher: str) -> DataFrame:
    """SNK-07: titled records as the nine columns of the registry's table, nulls as empty texts, no publisher as ``publisher``."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return r.where("title is not null").select(
        text(F.col("doi")).alias("doi"), text(target_url(F.col("file"), host, root)).alias("target"), "title", F.array_join("creators", "; ").alias("creators"), F.coalesce("publisher", F.lit(publisher)).alias("publisher"),
        text(year(F.col("date"))).alias("year"), *(text(F.col(c)).alias(c) for c in ("language", "description", "country")),
    )


def with_doi(text: Column, identifier: Column) -> Column:
    """SNK-09: a record's text with the identifier in every DOI line, or in one after its end."""
    line = F.concat(F.lit("DOI:\tdoi:"), identifier)
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n", -1)
    has = F.exists(lines, lambda x: x.startswith("DOI:"))
    return F.when(has, F.array_join(F.transform(lines, lambda x: F.when(x.startswith("DOI:"), line).otherwise(x)), "\n")).otherwise(F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n"), line, F.lit("\n")))


def audit_table(entries: DataFrame) -> DataFrame:
    """SNK-08: entries in the seven columns of the audit's table, nulls as empty texts. The identifier is as written, that of the
    registry where the record has none; the title likewise. An entry of one outside source alone is named after it. decision: a
    column of ``entries`` if they have been reviewed, else pending."""
    text = lambda *cs: F.coalesce(*cs, F.lit(""))
    named = F.coalesce("path", F.when(F.col("r_doi").isNotNull(), F.concat(F.lit("(DataCite only) "), text(F.col("r_title")))), F.concat(F.lit("(HTML only) "), F.col("key")))
    decision = F.trim(F.col("decision")) if "decision" in entries.columns else F.lit("···")
    return entries.select("status", decision.alias("decision"), text(F.col("doi"), F.col("r_doi")).alias("doi"), text(F.col("title"), F.col("r_title")).alias("title"), text(F.col("bank")).alias("bank"), text(named).alias("path"), text(F.col("target_url")).alias("target_url"))


def audit_breakdown(entries: DataFrame) -> DataFrame:
    """SNK-08: what is printed after the table, (place, label, n): the statuses in the order of their names, then TOTAL."""
    each = entries.groupBy(F.col("status").alias("label")).agg(F.count("*").alias("n"))
    # as many rows as there are statuses
    placed = each.withColumn("place", F.row_number().over(Window.orderBy("label")))
    total = each.agg(F.lit("TOTAL").alias("label"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.count("*") + 1).cast("int").alias("place"))
    return placed.unionByName(total)


def breakdown(entries: DataFrame) -> DataFrame:
    """AGG-24, SNK-08: entries by status, in the order of the labels."""
    return entries.groupBy("status").agg(F.count("*").alias("n")).orderBy("status")
