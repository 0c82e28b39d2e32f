"""An append-and-amend table of immutable files, with a manifest for every version.

    <path>/data/<id>/*.parquet     data files, never changed
    <path>/deleted/<id>/*.parquet  deletion vectors: (file, row_index) of rows that no longer count
    <path>/_versions/<n>.json      manifest of version n: its data folders, its deletion folders, whether it only moved
                                   rows to other files, and the sources processed

A manifest is created exclusively, so of two writers of one version only one succeeds. The difference of two versions is
the difference of their manifests: rows of added folders, less rows that added deletion vectors name. A version that only
moved rows (a compaction) adds nothing to a difference. A run that reads such a difference saves the version it has
processed in the same manifest that adds its output: either both are kept or neither, so a run that fails anywhere is
repeated without skipping or repeating records.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mnemolake.session import materialize


class VersionConflict(RuntimeError):
    """Another writer committed this version first."""


def _below(folder: str) -> Column:
    """The file that a row was read from, named from below a folder of the table."""
    return F.substring_index(F.col("_metadata.file_path"), f"/{folder}/", -1)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _fs(self, p: str):
        h = self._jvm.org.apache.hadoop.fs.Path(p)
        return h.getFileSystem(self._conf), h

    def version(self) -> int:
        """The latest version; 0 is the empty table."""
        fs, p = self._fs(f"{self.path}/_versions")
        if not fs.exists(p):
            return 0
        return max((int(n[:-5]) for s in fs.listStatus(p) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if v == 0:
            return {"version": 0, "data": [], "deleted": [], "processed": {}, "moved": False}
        fs, p = self._fs(f"{self.path}/_versions/{v}.json")
        stream = fs.open(p)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> int:
        """Write aside, then rename to the version's name: the rename fails if that version exists."""
        v = manifest["version"]
        fs, tmp = self._fs(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, to = self._fs(f"{self.path}/_versions/{v}.json")
        claim = self._fs(f"{self.path}/_versions/.claim-{v}")[1]
        if fs.exists(to) or not fs.createNewFile(claim):
            if fs.exists(to):
                fs.delete(tmp, False)
                raise VersionConflict(f"version {v} exists")
            # a writer died between its claim and its rename: its claim is void, the version doesn't exist
        if not fs.rename(tmp, to):
            fs.delete(tmp, False)
            raise VersionConflict(f"version {v} exists")
        return v

    def commit(
        self,
        added: DataFrame | None = None,
        deleted: DataFrame | None = None,
        drop: list[str] | None = None,
        processed: dict[str, int] | None = None,
        base: int | None = None,
        moved: bool = False,
    ) -> int:
        """A new version: rows added, rows deleted by (file, row_index), whole folders dropped, and the sources processed so far.

        moved says that the rows added are the live ones of the folders dropped. Once all folders of the base are dropped, none
        of its deletion vectors names a row any more, and they leave the manifest.
        """
        m = self.manifest(base)
        data = [d for d in m["data"] if d not in (drop or [])]
        gone = list(m["deleted"]) if data else []
        if added is not None:
            name = uuid.uuid4().hex
            added.select(*self.schema.fieldNames()).write.parquet(f"{self.path}/data/{name}")
            data.append(name)
        if deleted is not None:
            name = uuid.uuid4().hex
            deleted.select("file", "row_index").write.parquet(f"{self.path}/deleted/{name}")
            gone.append(name)
        return self._publish({"version": m["version"] + 1, "data": data, "deleted": gone, "moved": moved, "processed": {**m["processed"], **(processed or {})}})

    def compact(self, processed: dict[str, int] | None = None) -> int:
        """Write the live rows as new files; the old folders and deletion vectors leave the manifest. Differences don't show it."""
        m = self.manifest()
        return self.commit(added=self.read(m["version"]), drop=m["data"], base=m["version"], moved=True, processed=processed) if m["data"] else m["version"]

    def land(self, rows: DataFrame, version: Column, keys: list[str], order: Column, versions: int) -> int:
        """Fill an empty table with versions 1 to `versions` at once: a row joins at `version`, and leaves at the version in which a later row of its keys joins.

        One pass writes the data, a folder a version; a second one reads keys and positions only. Of each key and version the
        last row counts, chosen before the shuffle, so a key with any number of rows brings one row a task and version.
        """
        if self.version():
            raise VersionConflict("the table isn't empty")
        name, spot = uuid.uuid4().hex, "_v"
        rows.withColumn(spot, version.cast("int")).select(*self.schema.fieldNames(), spot).write.partitionBy(spot).parquet(f"{self.path}/data/{name}")
        have = self._folders(f"data/{name}")
        if have:
            read = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(spot, T.IntegerType())])).parquet(f"{self.path}/data/{name}")
            row = read.select(*keys, spot, order.alias("_o"), _below("data").alias("file"), F.col("_metadata.row_index").alias("row_index"))
            last = row.groupBy(*keys, spot).agg(F.max(F.struct("_o", "file", "row_index")).alias("l"))
            after = F.lead(spot).over(Window.partitionBy(*keys).orderBy(spot))
            last = materialize(last.select(*keys, F.col("l.file").alias("file"), F.col("l.row_index").alias("row_index"), after.alias("until")), "last-rows")
            at = ["file", "row_index"]
            # the rows of a version that aren't its key's last leave as they join
            passed = row.select(*at, spot).join(last.select(*at).hint("merge"), at, "left_anti")
            gone = last.where("until is not null").select(*at, F.col("until").alias(spot)).unionByName(passed)
            gone.write.partitionBy(spot).parquet(f"{self.path}/deleted/{name}")
        vectors = self._folders(f"deleted/{name}") if have else set()
        data, deleted = [], []
        for v in range(1, versions + 1):
            folder = f"{name}/{spot}={v}"
            data += [folder] if folder in have else []
            deleted += [folder] if folder in vectors else []
            self._publish({"version": v, "data": list(data), "deleted": list(deleted), "moved": False, "processed": {}})
        return versions

    def _folders(self, below: str) -> set[str]:
        """The folders of one written table, named from below the kind of file."""
        fs, p = self._fs(f"{self.path}/{below}")
        return {f"{below.split('/', 1)[1]}/{s.getPath().getName()}" for s in fs.listStatus(p) if s.isDirectory()} if fs.exists(p) else set()

    def _rows(self, folders: list[str]) -> DataFrame:
        """Rows of data folders with their position (_file, _row)."""
        if not folders:
            return self.spark.createDataFrame([], self.schema).withColumns({"_file": F.lit("").cast("string"), "_row": F.lit(0).cast("bigint")})
        df = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])
        return df.select("*", _below("data").alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def _vectors(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], "file string, row_index bigint")
        return self.spark.read.schema("file string, row_index bigint").parquet(*[f"{self.path}/deleted/{f}" for f in folders])

    def positions(self, version: int | None = None) -> DataFrame:
        """The rows of a version with their position, for commit(deleted=...)."""
        m = self.manifest(version)
        rows = self._rows(m["data"])
        if not m["deleted"]:
            return rows
        dv = self._vectors(m["deleted"])
        return rows.join(dv, (rows["_file"] == dv["file"]) & (rows["_row"] == dv["row_index"]), "left_anti")

    def read(self, version: int | None = None) -> DataFrame:
        return self.positions(version).drop("_file", "_row")

    def upsert(self, rows: DataFrame, keys: list[str], processed: dict[str, int] | None = None) -> int:
        """Replace the rows of these keys; nothing is rewritten, the old rows enter a deletion vector."""
        v = self.version()
        old = self.positions(v).join(rows.select(*keys).distinct(), keys, "left_semi").select(F.col("_file").alias("file"), F.col("_row").alias("row_index"))
        return self.commit(rows, old if v else None, processed=processed, base=v)

    def diff(self, start: int, end: int | None = None) -> DataFrame:
        """Record deltas from one version to another: the schema plus change, `+` or `-`.

        Only added folders, dropped folders and folders that new deletion vectors touch are read. Versions that only moved rows
        are passed over; what was added before one and removed after it cancels out by value.
        """
        last = self.version() if end is None else end
        moves = [v for v in range(start + 1, last + 1) if self.manifest(v).get("moved")]
        if not moves:
            return self._diff(self.manifest(start), self.manifest(last))
        edges = [start, *[x for v in moves for x in (v - 1, v)], last]
        parts = [self._diff(self.manifest(a), self.manifest(b)) for a, b in zip(edges[::2], edges[1::2])]
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        net = both.groupBy(*self.schema.fieldNames()).agg(F.sum(F.when(F.col("change") == "+", 1).otherwise(-1)).alias("_n")).where("_n <> 0")
        net = net.withColumn("change", F.when(F.col("_n") > 0, "+").otherwise("-"))
        return net.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("_n")))).drop("_n")

    def _diff(self, a: dict, b: dict) -> DataFrame:
        new = [d for d in b["data"] if d not in a["data"]]
        old = [d for d in a["data"] if d not in b["data"]]
        kept = [d for d in a["data"] if d in b["data"]]
        new_dv = [d for d in b["deleted"] if d not in a["deleted"]]

        def live(folders: list[str], vectors: list[str]) -> DataFrame:
            rows, dv = self._rows(folders), self._vectors(vectors)
            return rows.join(dv, (rows["_file"] == dv["file"]) & (rows["_row"] == dv["row_index"]), "left_anti") if vectors else rows

        plus = live(new, b["deleted"])
        minus = live(old, a["deleted"])
        if kept and new_dv:
            rows, dv = live(kept, a["deleted"]), self._vectors(new_dv).distinct()
            minus = minus.unionByName(rows.join(dv, (rows["_file"] == dv["file"]) & (rows["_row"] == dv["row_index"]), "left_semi"))
        return plus.withColumn("change", F.lit("+")).unionByName(minus.withColumn("change", F.lit("-"))).drop("_file", "_row")

    def key_changes(self, starts: list[int], keys: list[str], content: str, end: int | None = None) -> DataFrame:
        """(*keys, start, change) of the keys whose record differs between a version of `starts` and the end, for all of them in one pass.

        Keys must be unique in every version. change is `new`, `changed` or `removed`; records are equal if `content` is. Read are
        keys, content and positions: of folders that joined or left since the first of starts all rows, of the others those that
        a deletion vector has named since. Each row is there from the version in which its folder joined to that in which its
        folder or itself left, so a key has at most one row a version; moved rows are no change, as their content is the same.
        """
        starts = sorted(set(starts))
        views = [self.manifest(v) for v in starts] + [self.manifest(end)]
        n = len(starts)  # the end's place in views
        joined, left = {}, {}
        for i, m in enumerate(views):
            for d in m["data"]:
                joined.setdefault(d, i)
            for d in joined.keys() - set(m["data"]):
                left.setdefault(d, i)
        vector = {}
        for i, m in enumerate(views):
            for d in m["deleted"]:
                vector.setdefault(d, i)
        at = ["_file", "_row"]
        fresh = [d for d in joined if joined[d] > 0 or d in left]
        kept = [d for d in joined if joined[d] == 0 and d not in left]
        since = [d for d in vector if vector[d] > 0]

        def place(folder: Column, of: dict[str, int], other: int) -> Column:
            """The number that `of` gives the folder, looked up in a literal with an entry a folder."""
            return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), folder), F.lit(other)) if of else F.lit(other)

        folder = F.regexp_replace("_file", "/[^/]*$", "")
        never = n + 1
        dv = self.spark.createDataFrame([], "_file string, _row bigint, _gone int")
        if since:
            dv = self.spark.read.schema("file string, row_index bigint").parquet(*[f"{self.path}/deleted/{d}" for d in since])
            by = place(F.regexp_replace(_below("deleted"), "/[^/]*$", ""), vector, never)
            dv = dv.select(F.col("file").alias("_file"), F.col("row_index").alias("_row"), by.alias("_gone")).groupBy(*at).agg(F.min("_gone").alias("_gone"))
        cols = [*keys, F.col(content).alias("_c"), *at]
        rows = self._rows(fresh).select(*cols).join(dv.hint("merge"), at, "left")
        if kept and since:
            rows = rows.unionByName(self._rows(kept).select(*cols).join(dv.hint("merge"), at))
        from_, to = place(folder, joined, never), F.least(F.coalesce("_gone", F.lit(never)), place(folder, left, never))
        rows = rows.select(*keys, from_.alias("a"), to.alias("z"), F.col("_c").alias("c")).where("a < z")
        spans = rows.groupBy(*keys).agg(F.collect_list(F.struct("a", "z", "c")).alias("s"))  # at most one row a version

        def seen(i: Column | int) -> Column:
            return F.try_element_at(F.filter("s", lambda x: (x["a"] <= i) & (x["z"] > i)), F.lit(1))

        def change(i: Column) -> Column:
            then, now = seen(i), seen(F.lit(n))
            kind = F.when(then.isNull() & now.isNotNull(), "new").when(then.isNotNull() & now.isNull(), "removed").when(~then["c"].eqNullSafe(now["c"]), "changed")
            return F.struct(i.alias("i"), kind.alias("change"))

        found = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), change), lambda x: x["change"].isNotNull())
        out = spans.select(*keys, F.explode(found).alias("d"))
        return out.select(*keys, F.element_at(F.array(*[F.lit(v).cast("bigint") for v in starts]), F.col("d.i") + 1).alias("start"), "d.change")


def process_changes(source: VersionedTable, target: VersionedTable, names: list[str], keys: list[str], content: str) -> int | None:
    """The keys that each of these consumers must process since the version it has processed last, into target: (name, *keys, change).

    One pass over source serves them all. The rows and the version that they were found up to enter target in one manifest.
    """
    base = target.manifest()
    now = source.version()
    since = {n: base["processed"].get(n, 0) for n in names}
    behind = {n: v for n, v in since.items() if v < now}
    if not behind:
        return None
    found = source.key_changes(list(behind.values()), keys, content, now)
    who = source.spark.createDataFrame(list(behind.items()), "name string, start bigint")  # one row a consumer
    return target.commit(found.join(who, "start").select("name", *keys, "change"), processed={n: now for n in behind}, base=base["version"])


def run_incremental(source: VersionedTable, target: VersionedTable, name: str, step: Callable[[DataFrame], DataFrame], keys: list[str] | None = None) -> int | None:
    """Process what changed in source since the last kept run of `name`, into target.

    step maps the deltas to output rows. The output and the version processed enter target in one manifest; with keys the
    output replaces rows of the same keys. Returns target's new version, or None if nothing changed.
    """
    base = target.version()
    since = target.manifest(base)["processed"].get(name, 0)
    now = source.version()
    if now == since:
        return None
    out = step(source.diff(since, now))
    if keys:
        return target.upsert(out, keys, {name: now})
    return target.commit(out, processed={name: now}, base=base)
