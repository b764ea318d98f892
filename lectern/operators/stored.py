"""Written tables that change course by course: rows, an inverted index over them, one commit for all.

A change is a *batch*: every table of it is written below ``batch=N``, then a row in ``commits`` makes all of them visible
together. A batch that failed half-way has no commit row, is seen by nobody and is written over by the next one. One writer
at a time. ``compact`` writes the present state as one batch from which readers start.

``Rows``       keyed rows; the newest batch of a key counts, removed keys leave a marker
``TermIndex``  postings in term buckets, sorted by term and course; a change adds *signed differences* of term frequency,
               length, document frequency and totals, so that sums over batches are the numbers of a rebuilt index,
               and documents that did not change add nothing
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.lists import let
from lectern.operators import retrieval
from lectern.session import work_path, written

_COMMIT = "batch long, base boolean, tables array<string>"


class Store:
    """A folder of tables and its commits."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._known: list | None = None
        self._schemas: dict = {}

    @classmethod
    def temporary(cls, spark: SparkSession, label: str) -> Store:
        return cls(spark, work_path(spark, label))

    def refresh(self) -> None:
        """Look for commits of another writer at the next read."""
        self._known = None

    def _commits(self) -> list:
        if self._known is None:
            self._known = self._listed()
        return self._known

    def _listed(self) -> list:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        return sorted(self.spark.read.schema(_COMMIT).parquet(f"{self.folder}/commits").collect(), key=lambda r: r.batch)

    def begin(self) -> Change:
        self.refresh()
        return Change(self, max((r.batch for r in self._commits()), default=-1) + 1)

    def parts(self, table: str) -> list[int]:
        """Visible batches of a table: those since the last base that hold it. As many as changes since ``compact``."""
        commits = self._commits()
        start = max((r.batch for r in commits if r.base), default=0)
        return [r.batch for r in commits if r.batch >= start and table in r.tables]

    def read(self, table: str) -> DataFrame:
        paths = [f"{self.folder}/{table}/batch={n}" for n in self.parts(table)]
        if not paths:
            raise LookupError(f"{self.folder} has no table {table}")
        reader = self.spark.read.option("basePath", f"{self.folder}/{table}")
        if table in self._schemas:  # the columns of a table stay: looked up in its files once
            return reader.schema(self._schemas[table]).parquet(*paths)
        rows = reader.parquet(*paths)
        self._schemas[table] = rows.schema
        return rows


class Change:
    """A batch under way; leaving the ``with`` block without an error commits it."""

    def __init__(self, store: Store, batch: int, base: bool = False):
        self.store, self.batch, self.base, self.tables = store, batch, base, []

    def write(self, table: str, rows: DataFrame, *, cluster: Sequence[str] = (), by: str | None = None, place: str | None = None) -> DataFrame:
        """``cluster`` sorts, so that files hold narrow ranges: of ranges of all rows, or with ``by``, which makes folders of a column,
        inside even parts of a folder (``rebalance``: no pass over the rows to find ranges, and a large folder has many parts).
        ``place`` is a column to be added that numbers the rows as they are written: neighbours in the order have neighbouring numbers."""
        path = f"{self.store.folder}/{table}/batch={self.batch}"
        if by:
            rows = rows.hint("rebalance", by)
        if cluster:
            rows = (rows if by else rows.repartitionByRange(*cluster)).sortWithinPartitions(*cluster)
        if place:
            rows = rows.withColumn(place, F.monotonically_increasing_id())
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        self.tables.append(table)
        return self.store.spark.read.parquet(path)

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and self.tables:
            row = self.store.spark.range(1).select(
                F.lit(self.batch).cast("long").alias("batch"), F.lit(self.base).alias("base"), F.array(*map(F.lit, self.tables)).alias("tables")
            )
            row.coalesce(1).write.mode("append").parquet(f"{self.store.folder}/commits")
            self.store.refresh()


class Rows:
    """Rows by key, the newest batch of a key counts. With ``place`` they get such a column when written (``Change.write``)."""

    def __init__(self, store: Store, name: str, keys: Sequence[str] = ("video_id", "chunk_id"), place: str | None = None):
        self.store, self.name, self.keys, self.place = store, name, list(keys), place

    def all(self) -> DataFrame:
        rows = self.store.read(self.name)
        if len(self.store.parts(self.name)) > 1:
            rest = [c for c in rows.columns if c not in self.keys]
            rows = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*self.keys, "_r.*")
        return rows.filter("NOT _gone").drop("_gone", "batch")

    def put(self, change: Change, new: DataFrame, gone: DataFrame | None = None) -> None:
        rows = new.withColumn("_gone", F.lit(False))
        if gone is not None:
            rows = rows.unionByName(gone.select(*self.keys).withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        change.write(self.name, rows, cluster=self.keys, place=self.place)


class TermIndex:
    """Inverted index of documents (video_id, chunk_id, text) by ``split``: words for ranking, three-character pieces for
    substring search. The empty term stands for the document itself. ``distinct``: ``split`` gives no term of a document twice."""

    def __init__(self, store: Store, name: str, split: Callable[[Column], Column] = X.tokens, buckets: int = 16, distinct: bool = False):
        self.store, self.name, self.split, self.buckets, self.distinct = store, name, split, buckets, distinct

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.hash("term"), F.lit(self.buckets)))

    def put(self, change: Change, new: DataFrame, old: DataFrame | None = None, grouped: bool = False) -> None:
        """Adds the postings of ``new`` and takes off those of ``old``, the texts of the same documents so far. ``grouped``: no document of
        ``new`` stands in several rows."""
        signed = self._postings(new, 1, grouped) if old is None else self._difference(new, old)
        rows = change.write(f"{self.name}_postings", self._bucketed(signed), cluster=["bucket", "term", "video_id"], by="bucket")
        frequency = rows.filter("term <> ''").groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
        change.write(f"{self.name}_frequency", self._bucketed(frequency), cluster=["bucket", "term"], by="bucket")
        totals = rows.filter("term = ''").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"))
        change.write(f"{self.name}_totals", totals)

    def _postings(self, docs: DataFrame, sign: int, grouped: bool = False) -> DataFrame:
        found = retrieval.postings(docs.select("video_id", "chunk_id", "text"), marked=True, split=self.split, grouped=grouped, distinct=self.distinct)
        one = F.lit(sign).cast("long")
        return found.select("video_id", "chunk_id", "term", (F.col("tf") * one).alias("tf"), (F.col("len") * one).alias("len"), one.alias("df"))

    def _difference(self, new: DataFrame, old: DataFrame) -> DataFrame:
        """What changes in the postings. Texts meet by document; those that stay are not split, and the words of two texts are set
        against each other inside their row."""
        keys = ["video_id", "chunk_id"]
        if retrieval.repeated(new, keys) or retrieval.repeated(old, keys):
            signed = self._postings(new, 1).unionByName(self._postings(old, -1))
            return signed.groupBy(*keys, "term").agg(*[F.sum(c).alias(c) for c in ("tf", "len", "df")]).filter("tf <> 0 OR len <> 0")
        here = F.lit(True)
        a, b = (rows.select(*[F.col(c).alias(f"_{n}{c}") for c in keys], here.alias(f"_{n}in"), F.col("text").alias(f"_{n}text")) for rows, n in ((new, "n"), (old, "o")))
        same = F.lit(True)
        for c in keys:
            same = same & F.col(f"_n{c}").eqNullSafe(F.col(f"_o{c}"))
        both = a.join(b, same, "full").filter("NOT (_nin <=> _oin AND _ntext <=> _otext)")
        both = both.select(*[F.coalesce(f"_n{c}", f"_o{c}").alias(c) for c in keys], self._against().alias("_f"))
        return both.select(*keys, F.explode_outer("_f").alias("_f")).select(*keys, "_f.*").filter("tf <> 0 OR len <> 0")

    def _against(self) -> Column:
        """Words of ``_ntext`` less those of ``_otext``, where these are there: array<struct<term, tf, len, df>>."""
        none, one = F.array().cast("array<string>"), F.struct(F.lit("").alias("term"), F.lit(1).cast("long").alias("tf"))

        def listed(n: str, sign: int) -> Column:
            def signed(words: Column) -> Column:
                by, size = F.lit(sign).cast("long"), F.size(words).cast("long")
                return F.transform(F.array_append(X.counted(words), one), lambda f: F.struct(
                    f["term"].alias("term"), (f["tf"] * by).alias("tf"), (size * by).alias("len"), by.alias("df")))

            return let(F.coalesce(self.split(F.col(f"_{n}text")), none), signed)

        def merged(rows: Column) -> Column:
            def sums(x: Column, i: Column) -> Column:
                before, after = F.get(rows, i - 1), F.get(rows, i + 1)
                both = F.struct(x["term"].alias("term"), *[(x[c] + after[c]).alias(c) for c in ("tf", "len", "df")])
                return F.when((i > 0) & (before["term"] == x["term"]), None).when(after["term"] == x["term"], both).otherwise(x)

            return F.filter(F.transform(rows, sums), lambda x: x.isNotNull())

        both = let(F.sort_array(F.concat(listed("n", 1), listed("o", -1))), merged)
        return F.when(F.col("_nin") & F.col("_oin"), both).when(F.col("_nin"), listed("n", 1)).otherwise(listed("o", -1))

    def _asked(self, table: str, wanted: DataFrame) -> DataFrame:
        terms = self._bucketed(wanted.select("term").distinct())
        return self.store.read(f"{self.name}_{table}").join(terms, ["bucket", "term"], "left_semi")

    def postings(self, wanted: DataFrame) -> DataFrame:
        """(video_id, chunk_id, term, tf, len) of the terms in ``wanted``."""
        rows = self._asked("postings", wanted)
        if len(self.store.parts(f"{self.name}_postings")) > 1:
            rows = rows.groupBy("video_id", "chunk_id", "term").agg(F.sum("tf").alias("tf"), F.sum("len").alias("len"))
        return rows.filter("tf > 0").select("video_id", "chunk_id", "term", "tf", "len")

    def frequency(self, wanted: DataFrame) -> DataFrame:
        rows = self._asked("frequency", wanted)
        return rows.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def totals(self) -> DataFrame:
        """One row: n_docs, avg_len."""
        rows = self.store.read(f"{self.name}_totals").agg(F.sum("n_docs").alias("n_docs"), F.sum("total").alias("total"))
        return rows.select("n_docs", (F.col("total") / F.greatest(F.col("n_docs"), F.lit(1))).alias("avg_len"))


class Library:
    """Chunks, their keyword index and their vectors, changed together. Vectors are written as they come, before they are ordered or
    meet anything: whoever makes them is asked once for each."""

    def __init__(self, store: Store, body: Callable[[], Column] = lambda: F.col("text")):
        self.store, self.body = store, body
        self.chunks, self.vectors = Rows(store, "chunks"), Rows(store, "vectors")
        self.words = TermIndex(store, "words")

    def _texts(self, chunks: DataFrame) -> DataFrame:
        return chunks.select("video_id", "chunk_id", self.body().alias("text"))

    def create(self, chunks: DataFrame, vectors: DataFrame) -> None:
        vectors = written(vectors, "embedded")
        with self.store.begin() as change:
            self.chunks.put(change, chunks)
            self.words.put(change, self._texts(chunks))
            self.vectors.put(change, vectors)

    def replace(self, chunks: DataFrame, vectors: DataFrame) -> None:
        """Every course in ``chunks`` is replaced as a whole; its vectors are those in ``vectors``. One commit."""
        chunks, vectors = written(chunks, "replacing"), written(vectors, "embedded")
        courses = chunks.select("video_id").distinct()
        old = written(self.chunks.all().join(courses, "video_id", "left_semi"), "replaced")
        keys = ["video_id", "chunk_id"]
        with self.store.begin() as change:
            self.chunks.put(change, chunks, old.join(chunks, keys, "left_anti"))
            self.words.put(change, self._texts(chunks), self._texts(old))
            stale = self.vectors.all().join(courses, "video_id", "left_semi").join(vectors, keys, "left_anti")
            self.vectors.put(change, vectors.join(courses, "video_id", "left_semi"), stale)

    def patch(self, changes: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> None:
        """Columns of single chunks change (video_id, chunk_id and the columns that are not null). Only chunks whose indexed text
        becomes another are indexed and embedded anew: ``embed`` gets them and gives rows of the vectors table."""
        keys = ["video_id", "chunk_id"]
        old = self.chunks.all().join(changes.select(*keys), keys, "left_semi")
        names = [c for c in changes.columns if c not in keys]
        both = old.join(changes.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in names]), keys)
        fresh = both.select(*[F.coalesce(f"_n_{c}", c).alias(c) if c in names else F.col(c) for c in old.columns], self.body().alias("_old"))
        fresh = written(fresh.withColumn("_new", self.body()), "patched")
        moved = fresh.filter(~F.col("_old").eqNullSafe(F.col("_new")))
        with self.store.begin() as change:
            self.chunks.put(change, fresh.drop("_old", "_new"))
            self.words.put(change, moved.select(*keys, F.col("_new").alias("text")), moved.select(*keys, F.col("_old").alias("text")))
            self.vectors.put(change, written(embed(moved.drop("_old", "_new")), "embedded"))

    def purge(self, courses: DataFrame) -> None:
        gone = written(self.chunks.all().join(courses.select("video_id"), "video_id", "left_semi"), "purged")
        with self.store.begin() as change:
            self.chunks.put(change, gone.limit(0), gone)
            self.words.put(change, self._texts(gone.limit(0)), self._texts(gone))
            stale = self.vectors.all().join(courses.select("video_id"), "video_id", "left_semi")
            self.vectors.put(change, stale.limit(0), stale)

    def compact(self) -> None:
        """The present state as one batch; older batches are read no more."""
        chunks, vectors = written(self.chunks.all(), "compact"), written(self.vectors.all(), "compact")
        change = self.store.begin()
        change.base = True
        with change:
            self.chunks.put(change, chunks)
            self.words.put(change, self._texts(chunks))
            self.vectors.put(change, vectors)
