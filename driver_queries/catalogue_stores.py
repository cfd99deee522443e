"""Annotation workflow, vector search, sinks and refreshes."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from driver_queries import adapters as A
from driver_queries import catalogue as base
from driver_queries.catalogue import STAMP, YEARS, query
from factloom.functions import text
from factloom.functions.vectors import distance, fit_dimension
from factloom.operators import align, annotations, filings, vectors
from factloom.plans.annotate import AnnotationStore
from factloom.plans.collect import collect_filings
from factloom.plans.facts import facts_of_ticker, refresh_facts
from factloom.plans.knowledge_base import store_filing_texts
from factloom.schemas import FILINGS
from factloom.session import cut_lineage, scratch_path
from factloom.sources import submissions, tables
from factloom.sources.jsonl import numbered_lines, read_records
from factloom.streaming.annotations import absorb_saves, current_states, track_saves

RECALL, NEAREST = 0.9, 10
RECORD_SEEN = "4-NOT SPECIFIED#1"

# --- annotation workflow -----------------------------------------------------


def _ingested(spark, sf):
    path = scratch_path(spark, "jsonl")
    A.jsonl_lines(spark, sf).select("value").write.text(path)
    return numbered_lines(spark, path)


@query
def jsonl_line_numbers(spark, sf):
    """Line numbers of each file run from 0 without a gap."""
    per_file = (
        _ingested(spark, sf)
        .groupBy("file_name")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("line_index").alias("low"),
            F.max("line_index").alias("high"),
            F.count_distinct("line_index").alias("different"),
        )
    )
    whole = (F.col("low") == 0) & (F.col("high") + 1 == F.col("n")) & (
        F.col("different") == F.col("n")
    )
    return per_file.agg(F.sum("n").alias("n_lines"), F.min(whole).alias("contiguous"))


@query
def jsonl_records(spark, sf):
    records, _, _ = read_records(_ingested(spark, sf))
    return records.select("ticker", "fy", F.length("record_json").alias("n_chars"))


@query
def jsonl_value_items(spark, sf):
    records, items, _ = read_records(_ingested(spark, sf))
    return items.join(records.select("record_id", "ticker"), "record_id").select(
        "ticker", "item_index", "original_tag", "original_value", "original_units"
    )


@query
def jsonl_rejects(spark, sf):
    _, _, rejected = read_records(_ingested(spark, sf))
    return rejected.select(
        F.regexp_extract("value", '"ticker":"([^"]*)"', 1).alias("ticker"),
        F.length("value").alias("n_chars"),
    )


def _uploaded(spark, lines, order):
    """Lines as eight files of fixed names, each in the given order."""
    path = scratch_path(spark, "upload")
    dealt = lines.repartition(8, "conv_id").sortWithinPartitions(*order)
    dealt.select("value").write.text(path)
    files, folder, jvm = tables._files(spark, path)
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-"):
            files.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, f"{name[:10]}.jsonl"))
    return path


@query
def annotation_ingest_again(spark, sf):
    """Files are taken in and their first items verified; then files of the same names that changed.

    The second ones have other values, and more lines at their end, which alone are new.
    """
    store = AnnotationStore(spark, scratch_path(spark, "store"))
    lines, later = A.jsonl_lines(spark, sf), F.col("conv_id") % 3 == 0
    store.ingest(_uploaded(spark, lines.filter(~later), ["conv_id"]))
    first = store.items().filter("item_index = 0")
    store.save(first.select("item_id", F.lit("verified").alias("status")))
    marked = F.regexp_replace("value", '"value":"(?!old)', '"value":"later ')
    store.ingest(_uploaded(spark, lines.withColumn("value", marked), [later, "conv_id"]))
    named = store.items().join(store.records().select("record_id", "ticker"), "record_id")
    state = store.annotations().select("item_id", "status")
    return named.join(state, "item_id").select(
        "ticker", "item_index", "original_tag", "original_value", "status"
    )


@query
def insert_or_ignore(spark, sf):
    """First event per user and type, unless a purchase of the user is stored already."""
    events = A.table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    stored = events.filter("event_type = 'purchase'").select("user_id", "event_type")
    fresh = annotations.new_rows(
        events, stored, ["user_id", "event_type"], F.col("ts"), F.col("event_id")
    )
    return fresh.select("user_id", "event_type", "event_id")


@query
def pending_shells(spark, sf):
    shells = annotations.pending_shells(A.document_items(spark, sf), A.label_annotations(spark, sf))
    return shells.select("item_id", "status")


@query
def annotation_state(spark, sf):
    events = A.annotation_events(spark, sf)
    state = annotations.latest_state(
        events, "item_id", F.col("updated_at").desc(), F.col("event_id").desc()
    )
    return state.select("item_id", "annotated_value", "annotation_comment", "status")


@query
def annotation_upsert(spark, sf):
    """Saves of other kinds replace the state left by views and signups."""
    events = A.annotation_events(spark, sf)
    old = F.col("annotation_comment").isin("view", "signup")
    current = annotations.latest_state(events.filter(old), "item_id", F.col("updated_at").desc())
    state = annotations.upsert_annotations(current, events.filter(~old))
    return state.select("item_id", "annotated_value", "annotation_comment", "status")


@query
def annotation_stream(spark, sf):
    """Saves written as JSON files and taken up by two incremental runs."""
    events = A.annotation_events(spark, sf)
    source, target, log = (scratch_path(spark, n) for n in ("saves", "taken", "log"))
    for early in (True, False):
        kinds = F.col("annotation_comment").isin("view", "signup", "click")
        chosen = events.filter(kinds if early else ~kinds).drop("event_id")
        # The default text form of a time stops at milliseconds.
        micros = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
        chosen.write.mode("append").options(**micros).json(source)
        absorb_saves(spark, source, target, log).awaitTermination()
    taken = spark.read.parquet(target)
    state = annotations.latest_state(taken, "item_id", F.col("updated_at").desc())
    return state.select("item_id", "annotated_value", "annotation_comment", "status")


@query
def annotation_state_stream(spark, sf):
    """Saves in three batches without order; a stateful operator holds the latest of each item."""
    events = A.annotation_events(spark, sf)
    source, target, log = (scratch_path(spark, n) for n in ("saves", "states", "log"))
    micros = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    for part in range(3):
        chosen = events.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).drop("event_id")
        chosen.write.mode("append").options(**micros).json(source)
        track_saves(spark, source, target, log).awaitTermination()
    state = current_states(spark, target)
    return state.select("item_id", "annotated_value", "annotation_comment", "status")


@query
def annotation_worklist(spark, sf):
    joined = annotations.items_with_annotations(
        A.document_items(spark, sf), A.label_annotations(spark, sf)
    )
    return annotations.prefill(joined).select(
        "item_id", "original_tag", "shown_value", "shown_comment", "shown_status"
    )


@query
def items_of_record(spark, sf):
    none = A.label_annotations(spark, sf)
    return annotations.items_of_record(A.turn_items(spark, sf), none, "c#1").select(
        "item_id", "item_index", "original_tag", "status"
    )


@query
def item_fact_match(spark, sf):
    rows = annotations.match_items_to_facts(
        A.tagged_items(spark, sf), A.numeric_facts(spark, sf)
    )
    return rows.groupBy("item_id", "tag", "outcome").agg(
        F.count("concept_name").alias("n_facts"), F.max("fact_value").alias("max_value")
    )


@query
def record_neighbours(spark, sf):
    return annotations.neighbours(A.order_records(spark, sf))


@query
def records_of_file(spark, sf):
    return annotations.record_ids(A.order_records(spark, sf), "1-URGENT")


@query
def record_by_id(spark, sf):
    return annotations.get_record(A.order_records(spark, sf), RECORD_SEEN).select("record_index")


@query
def uploaded_files(spark, sf):
    return annotations.file_names(A.order_records(spark, sf))


# --- vectors -----------------------------------------------------------------


def _centre(spark, sf) -> list[float]:
    mean = Summarizer.mean(array_to_vector(F.col("vector").cast("array<double>")))
    row = A.vectors(spark, sf).agg(vector_to_array(mean).alias("m")).first()
    return row["m"]


def _label_centres(spark, sf):
    """One query vector per label: the mean of its vectors."""
    mean = Summarizer.mean(array_to_vector(F.col("vector").cast("array<double>")))
    return (
        A.vectors(spark, sf)
        .groupBy("label")
        .agg(vector_to_array(mean).alias("query_vector"))
        .select(F.col("label").cast("bigint").alias("query_id"), "query_vector")
    )


def _rounded(df, *keep):
    return df.select(
        *keep,
        F.round("distance", 6).alias("distance"),
        F.round("score", 6).alias("score"),
    )


@query
def knn_l2(spark, sf):
    found = vectors.search(A.vectors(spark, sf), _centre(spark, sf), metric="l2")
    return _rounded(found, "id", "ticker")


@query
def knn_cosine(spark, sf):
    found = vectors.search(
        A.vectors(spark, sf), _centre(spark, sf), metric="cosine", min_score=0.1, limit=50
    )
    return _rounded(found, "id", "ticker")


@query
def knn_dot(spark, sf):
    found = vectors.search(
        A.vectors(spark, sf), _centre(spark, sf), ticker="L3", metric="dot", limit=5
    )
    return _rounded(found, "id", "ticker")


def _asked(spark, sf):
    """Every fiftieth row as a query."""
    some = A.vectors(spark, sf).filter(F.col("id") % 50 == 0)
    return some.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))


@query
def knn_batch(spark, sf):
    found = vectors.search_many(A.vectors(spark, sf), _asked(spark, sf), limit=NEAREST)
    return _rounded(found, "query_id", "id", "rank")


@query
def knn_batch_cosine(spark, sf):
    found = vectors.search_many(
        A.vectors(spark, sf), _label_centres(spark, sf), limit=NEAREST, metric="cosine", min_score=-1
    )
    return _rounded(found, "query_id", "id", "rank")


def _cells(spark, sf):
    """Cells of the even rows; the odd ones come later and fit nothing anew."""
    rows, path = A.vectors(spark, sf), scratch_path(spark, "cells")
    indexed, centres = vectors.assign_cells(rows.filter(F.col("id") % 2 == 0))
    vectors.store_cells(indexed, path)
    later = vectors.place_in_cells(rows.filter(F.col("id") % 2 == 1), centres)
    vectors.store_cells(later, path, "append")
    return spark.read.parquet(path), centres


@query
def ann_search(spark, sf):
    """Approximate search next to the exact one: recall over all queries, every distance again.

    A distance is compared with one that built-in functions compute on the found pair.
    """
    stored, centres = _cells(spark, sf)
    asked, rows = _asked(spark, sf), A.vectors(spark, sf)
    reach = vectors.measured_reach(stored, centres, NEAREST)
    found = vectors.search_cells(stored, centres, asked, probes=1, limit=NEAREST, reach=reach)
    found = cut_lineage(found, "found")
    exact = vectors.search_many(rows, asked, limit=NEAREST).select("query_id", "id")
    met = found.join(exact, ["query_id", "id"], "left_semi")
    reached = met.agg(F.count("*").alias("met")).join(exact.agg(F.count("*").alias("all")))
    pair = found.join(asked, "query_id").join(rows.select("id", F.col("vector").alias("v")), "id")
    off = F.abs(F.col("distance") - distance(F.col("query_vector"), F.col("v"), "l2"))
    told = pair.groupBy("query_id").agg(
        F.count("*").alias("n_found"), (F.max(off) < 1e-9).alias("distances_true")
    )
    recall = (F.col("met") >= RECALL * F.col("all")).alias("recall_reached")
    return told.join(reached).select("query_id", "n_found", recall, "distances_true")


@query
def ann_search_all_cells(spark, sf):
    """Probing every cell must give the exact neighbours."""
    stored, centres = _cells(spark, sf)
    found = vectors.search_cells(stored, centres, _asked(spark, sf), probes=len(centres))
    return _rounded(found, "query_id", "id", "rank")


@query
def vector_fit(spark, sf):
    """Vectors cut to 48 and padded to 80 numbers."""
    v = F.col("vector")
    cut, padded = fit_dimension(v, 48), fit_dimension(v, 80)

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double"))

    return A.vectors(spark, sf).select(
        "id",
        F.size(cut).alias("cut_size"),
        F.size(padded).alias("padded_size"),
        F.round(total(cut), 6).alias("cut_sum"),
        F.round(total(padded), 6).alias("padded_sum"),
    )


@query
def vector_prepare(spark, sf):
    """Defaults for missing date and source."""
    documents = A.vectors(spark, sf).select(
        "ticker",
        F.col("id").cast("string").alias("text"),
        F.when(F.col("label") > 4, F.lit("10-K_1")).alias("source"),
        "vector",
    )
    prepared = vectors.prepare_records(documents, 64, "2024-01-01")
    return prepared.select(
        "ticker", "text", "date", "source", F.size("vector").alias("dim")
    )


@query
def vector_listing(spark, sf):
    """The default limit, in the order of the columns."""
    return vectors.list_documents(A.vectors(spark, sf).select("id", "ticker", "vector"), "L3")


# --- sinks and refreshes -----------------------------------------------------


def _round_trip(spark, sf, fmt):
    derived = filings.derive_filings(A.raw_filings(spark, sf), STAMP)
    path = f"{scratch_path(spark, 'filings')}.{fmt}"
    tables.save_unless_empty(derived, path)
    return base._show_filings(tables.load_table(spark, path, FILINGS))


@query
def filings_parquet_round_trip(spark, sf):
    return _round_trip(spark, sf, "parquet")


@query
def filings_csv_round_trip(spark, sf):
    return _round_trip(spark, sf, "csv")


@query
def collect_filings_twice(spark, sf):
    """A stored table is completed once and then left alone."""
    path = scratch_path(spark, "collected")
    tables.write_table(base._stored_filings(spark, sf), path, "parquet")
    inputs = (
        base._securities(spark, sf),
        YEARS,
        base._mapping(spark, sf),
        A.raw_filings(spark, sf),
    )
    collect_filings(*inputs, path, "parquet", force_check=True, processed_at=STAMP)
    final = collect_filings(*inputs, path, "parquet", force_check=True, processed_at=STAMP)
    return base._show_filings(final)


def _described(spark, sf, ticker=None):
    return A.raw_filings(spark, sf).select(
        F.col("o_orderkey").alias("filing_id"),
        (F.col("ticker") if ticker is None else ticker).alias("ticker"),
        F.lit("x.htm").alias("xbrl_instance_url"),
        F.to_date("reportDate").alias("report_date_dt"),
        F.date_add(F.to_date("reportDate"), 60).alias("filing_date_dt"),
    )


def _fact_totals(stored):
    return stored.groupBy("ticker", "concept_name").agg(
        F.count(F.lit(1)).alias("n_facts"),
        F.round(F.sum(F.col("fact_value").cast("decimal(20,2)")).cast("double"), 2).alias("total"),
        *[F.max(c).cast("string").alias(c) for c in ("filing_date", "report_date")],
    )


@query
def facts_refresh(spark, sf):
    """Facts of American filers are stored first; the refresh adds all others."""
    path = scratch_path(spark, "facts")
    pages, described = A.filing_pages(spark, sf), _described(spark, sf)
    everyone = base._securities(spark, sf)
    refresh_facts(everyone.filter("exchange = 'BUILDING'"), described, pages, path)
    return _fact_totals(refresh_facts(everyone, described, pages, path))


@query
def facts_refresh_new_filings(spark, sf):
    """Early filings are stored first; the refresh adds later ones of the same tickers."""
    path = scratch_path(spark, "facts")
    pages, described = A.filing_pages(spark, sf), _described(spark, sf)
    everyone = base._securities(spark, sf)
    refresh_facts(everyone, described.filter("report_date_dt < '1995-07-01'"), pages, path)
    return _fact_totals(refresh_facts(everyone, described, pages, path))


@query
def facts_refresh_late_pages(spark, sf):
    """Pages of odd orders land after their filings were described; then every fifth page changes."""
    path = scratch_path(spark, "facts")
    pages, described = A.filing_pages(spark, sf), _described(spark, sf)
    everyone, key = base._securities(spark, sf), F.col("filing_id")
    refresh_facts(everyone, described, pages.filter(key % 2 == 0), path)
    refresh_facts(everyone, described, pages, path)
    renamed = F.replace("html", F.lit("us-gaap:Revenues"), F.lit("us-gaap:Sales"))
    changed = pages.withColumn("html", F.when(key % 5 == 0, renamed).otherwise(F.col("html")))
    return _fact_totals(refresh_facts(everyone, described, changed, path))


@query
def facts_refresh_numeric_tickers(spark, sf):
    """Tickers that are padded digits keep their zeros in a table stored by ticker."""
    path = scratch_path(spark, "facts")
    digits = F.substring("ticker", 2, 20)
    everyone = base._securities(spark, sf).withColumn("ticker", digits)
    described, pages = _described(spark, sf, digits), A.filing_pages(spark, sf)
    refresh_facts(everyone, described, pages, path)
    return _fact_totals(refresh_facts(everyone, described, pages, path))


@query
def facts_refresh_empty(spark, sf):
    """Pages without facts leave an empty placeholder that can be read and refreshed."""
    path = scratch_path(spark, "facts")
    pages = A.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("filing_id"), F.lit("<p>no facts</p>").alias("html")
    )
    everyone, described = base._securities(spark, sf), _described(spark, sf)
    refresh_facts(everyone, described, pages, path)
    stored = refresh_facts(everyone, described, pages, path)
    read = spark.read.parquet(f"{path}.read").select(F.count("*").alias("n_read"))
    return stored.agg(F.count("*").alias("n_facts")).join(read)


@query
def filing_texts_twice(spark, sf):
    """Texts per source and year; a second run keeps the stored ones, odd dates have a year too."""
    path = scratch_path(spark, "texts")
    docs = A.table(spark, sf, "documents")
    number = F.lpad(F.col("doc_id").cast("string"), 9, "0")
    year = (2010 + F.col("doc_id") % 10).cast("string")
    described = docs.select(
        F.col("source").alias("ticker"),
        F.lit("1").alias("cik"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("odd"))
        .otherwise(F.concat(year, F.lit("-02-20")))
        .alias("filingDate"),
        number.alias("accessionNumber"),
        F.lit(None).cast("string").alias("documents_url"),
        "lang",
    )
    raw = docs.select(
        number.alias("accessionNumber"),
        F.concat(F.lit("<DOCUMENT><TYPE>10-K<TEXT>"), "text", F.lit("</TEXT>")).alias("raw"),
    )
    store_filing_texts(described.filter("lang = 'en'").drop("lang"), raw, path)
    store_filing_texts(described.drop("lang"), raw, path)
    schema = "ticker string, year string, accessionNumber string, raw string"
    stored = spark.read.schema(schema).parquet(path)
    return stored.select("ticker", "year", "accessionNumber", F.length("raw").alias("n_chars"))


# --- files, catalog tables and helpers ---------------------------------------


@query
def submissions_read(spark, sf):
    """Index documents as text: the newest filings of a company below a key, or at the root."""
    raw = A.raw_filings(spark, sf)
    fields = ["accessionNumber", "filingDate", "reportDate", "form", "primaryDocument"]
    order = F.array_sort(F.collect_list(F.struct("o_orderkey", *fields)))
    grouped = raw.groupBy("cik").agg(order.alias("rows"))
    lists = F.struct(*[F.col(f"rows.{f}").alias(f) for f in fields])
    nested = F.to_json(F.struct(F.struct(lists.alias("recent")).alias("filings")))
    files = grouped.select(
        F.lpad("cik", 10, "0").alias("cik"),
        F.lit(0).alias("source_rank"),
        F.concat(F.lit("CIK"), F.lpad("cik", 10, "0"), F.lit(".json")).alias("file_name"),
        F.when(F.col("cik").endswith("2"), nested).otherwise(F.to_json(lists)).alias("value"),
    )
    found = submissions.filings_from_json(files)
    return found.select("cik", "position", "accessionNumber", "filingDate", "form")


@query
def revenue_csv(spark, sf):
    """The revenue series written as CSV with a header and read again."""
    path = scratch_path(spark, "revenue")
    tables.write_csv(base.revenue_series(spark, sf), path)
    schema = "ticker string, year bigint, revenue double, unit string, report_date string"
    return spark.read.option("header", True).schema(schema).csv(path)


@query
def vector_table(spark, sf):
    """Rows are added, cleared, and added again in two parts."""
    store = tables.VectorTable(spark, scratch_path(spark, "vectors"), 16)
    docs = A.vectors(spark, sf).select(
        "ticker", F.col("id").cast("string").alias("text"), "vector", "label"
    )
    store.add(docs, "2024-01-01")
    store.clear()
    for part in (0, 1):
        store.add(docs.filter(F.col("label") % 2 == part).drop("label"), f"2024-01-0{part + 1}")
    return store.read().select("ticker", "text", "date", F.size("vector").alias("dim"))


@query
def facts_of_one_ticker(spark, sf):
    """Facts of one ticker, parsed and not stored."""
    facts = facts_of_ticker(_described(spark, sf), A.filing_pages(spark, sf), "T000002")
    return _fact_totals(facts)


def _string_totals(stored):
    """Totals per concept, by hash per value first: the greatest of texts alone would sort all rows."""
    per_value = stored.groupBy("concept_name", "value").agg(
        F.count("*").alias("n"), F.min(F.col("date").cast("date")).alias("first")
    )
    return per_value.groupBy("concept_name").agg(
        F.sum("n").alias("n_facts"),
        F.max("value").alias("last"),
        F.min("first").cast("string").alias("first_date"),
    )


@query
def string_facts_appended(spark, sf):
    """Text facts appended to a catalog table, one kind after the other."""
    name, path = f"texts_{uuid.uuid4().hex}", scratch_path(spark, "catalog")
    facts = A.numeric_facts(spark, sf).select(
        "concept_name", F.col("ticker").alias("value"), F.col("filing_date").cast("string").alias("date")
    )
    spark.sql(
        f"CREATE TABLE {name} (concept_name STRING, value STRING, date STRING)"
        f" USING parquet LOCATION '{path}'"
    )
    early = F.col("concept_name") < "M"
    for kind in (early, ~early):
        tables.append_string_facts(facts.filter(kind), name)
    rows = cut_lineage(_string_totals(spark.table(name)), "stored")
    spark.sql(f"DROP TABLE {name}")
    return rows


@query
def facts_with_metadata(spark, sf):
    """Facts appended twice to a catalog table with other metadata each time."""
    name = f"facts_{uuid.uuid4().hex}"
    path = scratch_path(spark, "catalog")
    numeric = A.numeric_facts(spark, sf).select("concept_name", "fact_value", "ticker")
    spark.sql(
        f"CREATE TABLE {name} (concept_name STRING, fact_value DOUBLE, ticker STRING, form STRING)"
        f" USING parquet LOCATION '{path}'"
    )
    for form in ("10-K", "10-Q"):
        tables.append_facts(numeric, name, {"form": form})
    stored = spark.table(name).groupBy("form", "concept_name").agg(F.count("*").alias("n_facts"))
    rows = cut_lineage(stored, "stored")
    spark.sql(f"DROP TABLE {name}")
    return rows


@query
def text_helpers(spark, sf):
    """Names made safe for files, and texts cut after 200 characters."""
    docs = align.require(A.table(spark, sf, "documents"), ["doc_id", "text", "lang", "source"])
    docs = align.present_columns(docs, ["doc_id", "source", "text", "no_such_column"])
    name = F.concat("source", F.lit("/a b."), F.col("doc_id").cast("string"))
    return docs.select(
        "doc_id",
        text.normalise_name(name).alias("name"),
        F.md5(text.truncate(F.col("text"), 200)).alias("digest"),
    )
