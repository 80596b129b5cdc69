"""Ingesting parsed feed rows into the star model: one batch, and whole runs over windows and categories."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.dates import parse, windows
from ..functions.text import clean_abstract, normalize_author, primary_category
from ..operators import cubes, upsert
from ..operators.sampling import quota
from ..sources.tables import Draft, Versions, in_buckets
from ..streaming.incremental import complete, progress, resume_offset, window_key
from .indexing import finish, run_stages


def papers_from(raw: DataFrame, now) -> DataFrame:
    """Rows of the papers table from raw feed rows; rows without an identifier are left out."""
    published = parse(F.col("published"), now)
    return raw.where("arxiv_id is not null and arxiv_id <> ''").select(
        "arxiv_id", "title", "abstract", clean_abstract(F.col("abstract")).alias("abstract_clean"),
        published.alias("published_date"), parse(F.col("updated"), published).alias("updated_date"), "doi", "journal_ref",
        primary_category(F.col("primary_category"), F.col("categories")).alias("primary_category_code"),
        now.alias("created_at"), now.alias("updated_at"),
    )


def ingest(tables: dict[str, DataFrame], raw: DataFrame, now=None) -> dict[str, DataFrame]:
    """New versions of papers (with ``action``), authors, paper_authors, categories and paper_categories.

    Categories come before papers, so every paper's primary code exists. Running it again changes nothing.
    """
    now = F.current_timestamp() if now is None else now
    raw = raw.where("arxiv_id is not null and arxiv_id <> ''")
    new = papers_from(raw, now)
    codes = raw.select(F.explode("categories").alias("code")).unionAll(new.select(F.col("primary_category_code").alias("code"))).select("code", F.lit(None).cast("string").alias("display_name"))
    named = raw.select("arxiv_id", F.posexplode("authors").alias("position", "name")).withColumn("name_normalized", normalize_author(F.col("name")))
    authors = upsert.with_ids(tables["authors"], named, "name_normalized", "name", ["arxiv_id", "position"])
    return {
        "categories": upsert.insert_ignore(tables["categories"], codes, ["code"], ["code"]),
        "papers": upsert.upsert(tables["papers"], new, ["arxiv_id"], "updated_date", ("published_date", "created_at")),
        "authors": authors,
        "paper_authors": upsert.insert_ignore(tables["paper_authors"], upsert.author_links(raw, authors, normalize_author), ["paper_id", "author_id"], ["position"]),
        "paper_categories": upsert.insert_ignore(tables["paper_categories"], upsert.category_links(raw), ["paper_id", "category_code"], ["is_primary"]),
    }


#: The star model's keyed tables: schema and the key whose hash deals rows to buckets.
KEYED = {
    "categories": (schemas.CATEGORIES, ["code"]),
    "papers": (schemas.PAPERS, ["arxiv_id"]),
    "authors": (schemas.AUTHORS, ["name_normalized"]),
    "paper_authors": (schemas.PAPER_AUTHORS, ["paper_id"]),
    "paper_categories": (schemas.PAPER_CATEGORIES, ["paper_id"]),
}


def create(store: Versions, bucket_rows: int = 100_000, statistics: bool = True) -> int:
    """The star model's empty tables as a version: keyed tables in buckets, the log of runs as one, and with ``statistics`` the cubes
    that every merge then keeps up to date."""
    with store.begin() as draft:
        for name, (schema, keys) in KEYED.items():
            draft.create(name, schema, keys, bucket_rows)
        if statistics:
            cubes.create(draft, bucket_rows)
        draft.put("runs", store.spark.createDataFrame([], schemas.RUNS))
        return draft.publish()


def merge(draft: Draft, raw: DataFrame, now=None) -> dict[str, int]:
    """``ingest`` of a batch into a draft's tables, and how many papers were inserted, updated and unchanged.

    Only buckets that the batch's keys fall into are read and written. New links are checked: a paper or an author that they
    name and the draft lacks is an error.
    """
    now = F.current_timestamp() if now is None else now
    raw = raw.where("arxiv_id is not null and arxiv_id <> ''")
    new = papers_from(raw, now)
    before: dict[str, DataFrame] = {}

    def seen(name: str, change: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, DataFrame], DataFrame]:
        """``change``, which notes the rows that it replaces."""

        def noted(old: DataFrame, batch: DataFrame) -> DataFrame:
            before[name] = old
            return change(old, batch)

        return noted

    codes = raw.select(F.explode("categories").alias("code")).unionAll(new.select(F.col("primary_category_code").alias("code"))).select("code", F.lit(None).cast("string").alias("display_name"))
    draft.merge("categories", codes, lambda old, batch: upsert.insert_ignore(old, batch, ["code"], ["code"]))
    named = raw.select("arxiv_id", F.posexplode("authors").alias("position", "name")).withColumn("name_normalized", normalize_author(F.col("name")))
    top = draft.notes("authors").get("top")
    authors = draft.merge("authors", named, lambda old, batch: upsert.with_ids(old, batch, "name_normalized", "name", ["arxiv_id", "position"], above=top))
    highest = authors.agg(F.max("id").alias("top")).first().top
    draft.notes("authors")["top"] = max(top or 0, highest or 0)
    papers = draft.merge("papers", new, seen("papers", lambda old, batch: upsert.upsert(old, batch, ["arxiv_id"], "updated_date", ("published_date", "created_at"))))
    links = upsert.author_links(raw, authors, normalize_author)
    after = {"papers": papers}
    # by paper, also of papers without links, so that all links of the batch's papers are at hand
    after["paper_authors"] = draft.merge("paper_authors", _of_papers(raw, links), seen("paper_authors", lambda old, batch: upsert.insert_ignore(old, batch.where("author_id is not null"), ["paper_id", "author_id"], ["position"])))
    after["paper_categories"] = draft.merge("paper_categories", _of_papers(raw, upsert.category_links(raw)), seen("paper_categories", lambda old, batch: upsert.insert_ignore(old, batch.where("category_code is not null"), ["paper_id", "category_code"], ["is_primary"])))
    draft.check(orphans=schemas.orphans(links, papers, "paper_id", "arxiv_id"), repeated=schemas.duplicate_keys(papers, "arxiv_id"))
    if "cube_days" in draft.held and before:
        ids = raw.select("arxiv_id").distinct()
        mine = lambda t: {k: v.join(ids if k == "papers" else ids.withColumnRenamed("arxiv_id", "paper_id"), "arxiv_id" if k == "papers" else "paper_id", "left_semi") for k, v in t.items()}
        cubes.change(draft, cubes.contributions(**mine(before)), cubes.contributions(**mine(after)))
    return draft.counts("papers")


def _of_papers(raw: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` and a row without a link for every paper of ``raw``."""
    return links.unionByName(raw.select(F.col("arxiv_id").alias("paper_id")).distinct(), allowMissingColumns=True)


def start_run(runs: DataFrame, run_id: int, categories: list[str], first: str, last: str, now=None) -> DataFrame:
    """The log (``schemas.RUNS``) with a new running run; a run that is there goes on from its checkpoint."""
    now = F.current_timestamp() if now is None else now
    if (going := runs.where((F.col("status") == "running") & (F.col("id") != run_id)).select("id").first()) is not None:
        raise RuntimeError(f"run {going.id} is in progress")
    if runs.where(F.col("id") == run_id).limit(1).count():
        return runs.withColumn("status", F.when(F.col("id") == run_id, "running").otherwise(F.col("status")))
    day = lambda d: F.lit(d).cast("timestamp")
    values = {"id": F.lit(run_id), "started_at": now, "status": F.lit("running"), "date_from": day(first), "date_to": day(last), "categories": F.array(*map(F.lit, categories)), **{c: F.lit(0) for c in runs.columns if c.startswith("papers_")}}
    row = runs.sparkSession.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in runs.schema])
    return runs.unionAll(row)


def counted(runs: DataFrame, run_id: int, **more: int) -> DataFrame:
    """The log with counters of one run raised, such as ``papers_embedded=20``."""
    return runs.withColumns({c: F.when(F.col("id") == run_id, (F.coalesce(c, F.lit(0)) + n).cast("int")).otherwise(F.col(c)) for c, n in more.items()})


def run(
    store: Versions,
    run_id: int,
    categories: list[str],
    first: str,
    last: str,
    fetch: Callable[[str, str, str, int, int], DataFrame],
    *,
    max_papers: int,
    page: int = 500,
    stages: Sequence[tuple[str, Callable[[], object]]] = (),
    now=None,
) -> DataFrame:
    """Ingests a date range week by week, in every week category by category, and gives the run's row of the log.

    ``fetch(category, win_start, win_end, offset, size)`` gives rows of ``schemas.RAW_PAPERS``, in feed order. Every category
    of every week has the same quota, so that ``max_papers``, the most rows fetched in a run, samples the whole range.
    A page reads and writes the buckets that its keys fall into (tables of ``create``). After every page the tables, the counters and the checkpoint are one new version of ``store``: whatever fails,
    the next call with the same ``run_id`` goes on at that offset, and no page counts twice. A failed fetch ends the run as
    failed. ``stages`` run at the end; their failures are warnings in the log.
    """
    spark, stamp = store.spark, F.current_timestamp() if now is None else now
    span = spark.range(1).select(F.lit(first).alias("date_from"), F.lit(last).alias("date_to"))
    weeks = [(str(w.win_start), str(w.win_end)) for w in windows(span).orderBy("win_start").collect()]  # the weeks of a range
    quota_ = quota(max_papers, len(weeks), len(categories))

    def save(change: Callable[[DataFrame], DataFrame], draft: Draft | None = None) -> DataFrame:
        with draft or store.begin() as draft:
            runs = draft.put("runs", change(draft.read("runs")))
            draft.publish(keep=2)
        return runs

    def mark(column, **more: int) -> Callable[[DataFrame], DataFrame]:
        mine = F.col("id") == run_id
        return lambda runs: counted(runs, run_id, **more).withColumn("last_checkpoint", F.when(mine, column).otherwise(F.col("last_checkpoint")))

    runs = save(lambda runs: start_run(runs, run_id, categories, first, last, now))
    for win_start, win_end in weeks:
        for category in categories:
            cell = F.lit(category), F.lit(win_start)
            point = F.col("last_checkpoint")
            at = runs.where(F.col("id") == run_id).select(
                F.array_contains(F.coalesce(point["done"], F.array().cast("array<string>")), window_key(*cell)).alias("done"), resume_offset(point, *cell).alias("offset"), F.coalesce("papers_fetched", F.lit(0)).alias("fetched")
            ).first()
            offset, fetched = at.offset, at.fetched
            if at.done or fetched >= max_papers:
                continue
            while (size := min(max_papers - fetched, quota_ - offset, page)) > 0:
                try:
                    landed = f"{store.root}/landed/{run_id}/{category}/{win_start}/{offset}"
                    fetch(category, win_start, win_end, offset, size).write.mode("overwrite").parquet(landed)
                except Exception as error:
                    save(lambda runs, offset=offset, cell=cell, error=error: finish(mark(progress(point, *cell, F.lit(offset)))(runs), run_id, "failed", [str(error)], stamp))
                    raise
                raw = spark.read.parquet(landed)
                n = raw.count()
                if not n:
                    break
                with store.begin() as draft:
                    done = merge(draft, raw, now)
                    offset, fetched = offset + n, fetched + n
                    runs = save(mark(progress(point, *cell, F.lit(offset)), papers_fetched=n, papers_inserted=done.get("insert", 0), papers_updated=done.get("update", 0)), draft)
                store.fs.delete(store._path("landed", str(run_id), category, win_start, str(offset - n)), True)
                if n < size:
                    break
            runs = save(mark(complete(point, *cell)))
    warnings = run_stages(list(stages))
    runs = save(lambda runs: finish(runs, run_id, "completed", warnings, stamp))
    return runs.where(F.col("id") == run_id)


def reset(tables: dict[str, DataFrame], token: str, expected: str, running: bool = False) -> dict[str, DataFrame]:
    """All tables empty, but for categories that have a name."""
    if token != expected:
        raise ValueError("the token does not match")
    if running:
        raise RuntimeError("a run is in progress")
    return {name: df.where("display_name is not null") if name == "categories" else df.limit(0) for name, df in tables.items()}


def reset_store(store: Versions, token: str, expected: str, indexes: Sequence[Versions] = ()) -> int:
    """``reset`` of a stored star model as a new version; the stored sparse index and concept graph (``indexes``) go."""
    held = store.latest() or {}
    running = "runs" in held and store.rows(held["runs"]).where("status = 'running'").limit(1).count() > 0
    left = reset({name: store.rows(entry) for name, entry in held.items()}, token, expected, running)
    with store.begin() as draft:
        for name, entry in held.items():
            if not in_buckets(entry):
                draft.put(name, left[name])
                continue
            draft.held[name] = {**entry, "buckets": {}, "notes": {}}
            if name == "categories":
                draft.merge(name, left[name], lambda old, batch: batch)
        number = draft.publish(keep=1)
    for index in indexes:
        index.delete()
    return number
