"""WARC fixity: replicas as bytes, hashed into Merkle trees over ordered offset ranges, compared from the roots down.

A replica is a table of records as they lie in its files: (file_id, record_offset, data binary). ``pack``
lays records out, each replica by itself, so a record that is lost, added, shortened or moved shifts
those after it. Within a file records go by the digest of their id; the tree follows its hexadecimal
digits, so a node is the stretch of the file whose digests begin alike. A node's hash covers its length and,
for each part in order of offset, the part's hash, its place relative to the node, and its length; so a
wrong offset or length is seen, and what merely shifted isn't. The id and the stated length of a record are
read from its bytes.

``audit`` keeps one row a file with the tree nested in it. Roots are compared first, in a read of the roots
alone; the trees of files that differ are then opened digit by digit, only below nodes that differ.

A record is intact if the other replica's file has the same bytes under its id; else damaged, missing (only
ours has it), extra (only the replica has it) or moved (the same bytes in another file). Two records of one
replica with one id are told apart by their bytes. Null page_id, url or html are written as empty. Identical
rows are one record with ``copies``: a record is stored once, so no group of copies can fill a file.
Files take records by digest, about FILE_RECORDS each, at any size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexspan.llm.common import discard, staged

FILE_RECORDS = 4096
MET_RECORDS = 100_000
KEYS = ("file_id", "path", "sha")
LEVELS = 3  # digits: a node of the last level has about one record of a file
MARK = "WARC-Record-ID: <urn:page:"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a WARC 1.0 resource record; its id is the page's, and a digest of address and content."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    body = text(html)
    name = F.concat(text(page_id), F.lit(":"), F.md5(F.concat(text(url), F.lit("\n"), body)))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), text(url), F.lit(f"\r\n{MARK}"), name, F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def _head(data: Column) -> Column:
    return F.substring_index(data.cast("string"), "\r\n\r\n", 1)


def record_id(data: Column) -> Column:
    """From the bytes: what the header names, empty if it names none."""
    return F.regexp_extract(_head(data), r"WARC-Record-ID: <urn:page:([^>]*)>", 1)


def well_formed(data: Column) -> Column:
    """Whether header, stated length and end mark account for all bytes."""
    stated = F.regexp_extract(_head(data), r"Content-Length: ([0-9]{1,15})", 1).try_cast("long")
    return F.coalesce(F.octet_length(data) == F.octet_length(_head(data)) + stated + 8, F.lit(False))


def file_of(name: Column, files: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(name, F.lit("/"))), 1, 8), 16, 10).cast("long") % files


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's records (file_id, path, sha, data, copies), each with its bytes once: what comes again is counted, and leaves as one row without bytes.

    So a group of copies sends its file a row or two from each task. MET_RECORDS digests are kept at most, then they are let go and met anew.
    """
    again: dict[tuple, int] = {}
    schema = None
    for b in batches:
        schema, new = b.schema, []
        for key, n in zip(zip(*(b.column(c).to_pylist() for c in KEYS), strict=True), b.column("copies").to_pylist(), strict=True):
            new.append(key not in again)
            again[key] = 0 if new[-1] else again[key] + n
        yield b.filter(pa.array(new, pa.bool_()))
        if len(again) >= MET_RECORDS:
            yield from _counted(again, schema)
            again.clear()
    if schema is not None:
        yield from _counted(again, schema)


def _counted(again: dict[tuple, int], schema: pa.Schema) -> list[pa.RecordBatch]:
    rows = [{**dict(zip(KEYS, key, strict=True)), "data": None, "copies": n} for key, n in again.items() if n]
    return pa.Table.from_pylist(rows, schema).to_batches()


def pack(records: DataFrame) -> DataFrame:
    """(file_id, record_offset, data, copies) of records (file_id, data, copies): one after the other, by the digest of their id, then of their bytes; all in one shuffle by file."""
    keyed = records.select(F.col("file_id").cast("long"), F.md5(record_id(F.col("data"))).alias("path"), F.unhex(F.sha2("data", 256)).alias("sha"), "data", F.col("copies").cast("long"))
    few = keyed.mapInArrow(_collapsed, "file_id long, path string, sha binary, data binary, copies long").repartition("file_id")
    each = few.groupBy(*KEYS).agg(F.first("data", ignorenulls=True).alias("data"), F.sum("copies").alias("copies")).withColumn("n", F.octet_length("data").cast("long"))
    w = W.partitionBy("file_id").orderBy("path", "sha").rowsBetween(W.unboundedPreceding, W.currentRow)
    return each.select("file_id", (F.sum("n").over(w) - F.col("n")).alias("record_offset"), "data", "copies")


def leaves(replica: DataFrame) -> DataFrame:
    """(file_id, path, id, start, length, sha, formed, copies) of a replica, from its bytes; ``copies`` is 1 where the replica doesn't say."""
    data, copies = F.col("data"), F.col("copies") if "copies" in replica.columns else F.lit(1)
    return replica.select("file_id", F.md5(record_id(data)).alias("path"), record_id(data).alias("id"), F.col("record_offset").alias("start"), F.octet_length(data).cast("long").alias("length"), F.unhex(F.sha2(data, 256)).alias("sha"), well_formed(data).alias("formed"), copies.cast("long").alias("copies"))


def _digest(parts: Column, start: Column, end: Column) -> Column:
    said = F.transform(parts, lambda x: F.concat_ws(":", F.lower(F.hex(x["hash"])), x["start"] - start, x["end"] - x["start"]))
    return F.unhex(F.sha2(F.concat(F.array_join(said, ","), F.lit("|"), (end - start).cast("string")), 256))


def tree(found: DataFrame) -> DataFrame:
    """(file_id, root, parts): one row a file; a part is (key, hash, start, end, parts) down to the records, all from one shuffle by file."""
    whole = F.col("start") + F.col("length")
    level = found.repartition("file_id").select("file_id", "path", F.struct("start", F.col("sha").alias("hash"), whole.alias("end"), "id", "formed", "copies").alias("part"))
    for digits in range(LEVELS, -1, -1):
        keys = ["file_id"] + [F.substring("path", 1, digits).alias("key")] * (digits > 0)
        node = level.groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("parts"), F.min("part.start").alias("start"), F.max("part.end").alias("end"))
        node = node.withColumn("hash", _digest(F.col("parts"), F.col("start"), F.col("end")))
        if not digits:
            return node.select("file_id", F.col("hash").alias("root"), "parts")
        level = node.select("file_id", F.col("key").alias("path"), F.struct("start", "hash", "end", "key", "parts").alias("part"))


def differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(file_id, a, b): what lies under last nodes that differ, as lists of records; below nodes that agree nothing is opened."""
    roots = ours.select("file_id", F.col("root").alias("ra")).join(theirs.select("file_id", F.col("root").alias("rb")), "file_id", "full")
    wrong = roots.filter(~F.col("ra").eqNullSafe(F.col("rb"))).select("file_id")
    a, b = (x.join(wrong, "file_id", "left_semi").select("file_id", F.col("parts").alias(n)) for x, n in ((ours, "a"), (theirs, "b")))
    pairs = a.join(b, "file_id", "full")
    for _ in range(LEVELS):
        digits = F.array_distinct(F.concat(*[F.coalesce(F.transform(F.col(n), lambda x: x["key"]), F.array()) for n in "ab"]))
        one = lambda n: F.get(F.filter(F.col(n), lambda x: x["key"] == F.col("digit")), 0)
        opened = pairs.withColumn("digit", F.explode(digits)).select("file_id", one("a").alias("x"), one("b").alias("y"))
        pairs = opened.filter(~F.col("x.hash").eqNullSafe(F.col("y.hash"))).select("file_id", F.col("x.parts").alias("a"), F.col("y.parts").alias("b"))
    return pairs


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Every record of both replicas (file_id, record_offset, data): where it lies in each, its digests, the roots of its file, and its ``status``.

    Columns: record_id, copies (of our record, 0 if we have none), file_id, record_offset, record_length, record_sha256, replica_file_id,
    replica_offset, replica_length, replica_sha256, well_formed (of the replica's bytes; null where it has none), root_sha256,
    replica_root_sha256, status.
    """
    a, b = (staged(tree(leaves(x)), "tree") for x in (ours, theirs))
    made: list[str] = []
    pairs = staged(differing(a, b), "differing", made)
    listed = lambda mine, other: pairs.select("file_id", F.explode(mine).alias("r"), F.transform(F.coalesce(other, F.array()), lambda x: x["hash"]).alias("others")).filter(~F.array_contains("others", F.col("r.hash")))
    left = listed(F.col("a"), F.col("b")).select("file_id", F.col("r.start").alias("start"), F.col("r.id").alias("id"), F.col("r.hash").alias("sha"), F.col("r.copies").alias("copies"))
    right = listed(F.col("b"), F.col("a")).select(F.col("file_id").alias("rf"), F.col("r.start").alias("rs"), (F.col("r.end") - F.col("r.start")).alias("rl"), F.col("r.id").alias("id"), F.col("r.hash").alias("rsha"), F.col("r.formed").alias("rformed"))
    # of one id: the same bytes meet first, then what is left in order
    same = left.join(right, (left["id"] == right["id"]) & (F.col("sha") == F.col("rsha"))).select(left["id"].alias("id"), "file_id", "start", "rf", "rs", "rl", "rsha", "rformed", F.lit("moved").alias("status"))
    rest_l = left.join(same.select("file_id", "start"), ["file_id", "start"], "left_anti")
    rest_r = right.join(same.select("rf", "rs"), ["rf", "rs"], "left_anti")
    nth = lambda x, f, s: x.withColumn("nth", F.row_number().over(W.partitionBy("id").orderBy(f, s)))
    status = F.when(F.col("rsha").isNull(), "missing").when(F.col("sha").isNull(), "extra").otherwise("damaged")
    other = nth(rest_l, "file_id", "start").join(nth(rest_r, "rf", "rs"), ["id", "nth"], "full").select("id", "file_id", "start", "rf", "rs", "rl", "rsha", "rformed", status.alias("status"))
    wrong = staged(same.unionByName(other), "wrong")
    discard(ours.sparkSession, made)
    return _report(a, b, wrong)


def _records(trees: DataFrame) -> DataFrame:
    out = trees.select("file_id", "root", F.explode("parts").alias("p"))
    for _ in range(LEVELS):
        out = out.select("file_id", "root", F.explode("p.parts").alias("p"))
    return out.select("file_id", "root", F.col("p.id").alias("id"), F.col("p.start").alias("start"), (F.col("p.end") - F.col("p.start")).alias("length"), F.col("p.hash").alias("sha"), F.col("p.formed").alias("formed"), F.col("p.copies").alias("copies"))


def _report(a: DataFrame, b: DataFrame, wrong: DataFrame) -> DataFrame:
    """Our records, with what the replica has instead of those found wrong; intact ones meet theirs by file, id and bytes."""
    mine = _records(a)
    theirs = _records(b).select(F.col("file_id").alias("of"), F.col("id").alias("name"), F.col("sha").alias("bytes"), F.col("start").alias("at"), F.col("length").alias("size"), F.col("formed").alias("fine"))
    found = mine.join(wrong.filter("file_id IS NOT NULL").drop("id"), ["file_id", "start"], "left")
    here = found.join(theirs, (F.col("file_id") == F.col("of")) & (F.col("id") == F.col("name")) & (F.col("sha") == F.col("bytes")) & F.col("status").isNull(), "left")
    roots = b.select(F.col("file_id").alias("rid"), F.col("root").alias("rroot"))
    pick = lambda x, y: F.coalesce(F.col(x), F.col(y))
    hexed = lambda x: F.lower(F.hex(x))
    ours = here.join(roots, F.col("file_id") == F.col("rid"), "left").select(
        F.col("id").alias("record_id"), "copies", "file_id", F.col("start").alias("record_offset"), F.col("length").alias("record_length"), hexed("sha").alias("record_sha256"),
        pick("rf", "of").alias("replica_file_id"), pick("rs", "at").alias("replica_offset"), pick("rl", "size").alias("replica_length"), hexed(pick("rsha", "bytes")).alias("replica_sha256"), pick("rformed", "fine").alias("well_formed"),
        hexed("root").alias("root_sha256"), hexed("rroot").alias("replica_root_sha256"), F.coalesce("status", F.lit("intact")).alias("status"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    extra = wrong.filter("file_id IS NULL").join(roots, F.col("rf") == F.col("rid"), "left").join(a.select(F.col("file_id").alias("fid"), "root"), F.col("rf") == F.col("fid"), "left").select(
        F.col("id").alias("record_id"), F.lit(0).cast("long").alias("copies"), none("long").alias("file_id"), none("long").alias("record_offset"), none("long").alias("record_length"), none("string").alias("record_sha256"),
        F.col("rf").alias("replica_file_id"), F.col("rs").alias("replica_offset"), F.col("rl").alias("replica_length"), hexed("rsha").alias("replica_sha256"), F.col("rformed").alias("well_formed"),
        hexed("root").alias("root_sha256"), hexed("rroot").alias("replica_root_sha256"), "status",
    )
    return ours.unionByName(extra)


def _page(data: Column) -> Column:
    return F.regexp_extract(record_id(data), r"^(-?[0-9]{1,19}):", 1)


def replicas(pages: DataFrame, per_file: int = FILE_RECORDS, paths: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Two replicas of pages (page_id, url, html), laid out apart; the first with how many rows each record is.

    The second one has planted faults, drawn by page_id: some records have lost their last ten bytes, some have another byte in their
    first line, some are missing, some lie in the next file, and some are followed by one that we don't have. The paths of both tables are added to ``paths``.
    """
    files = max(1, -(-pages.count() // per_file))
    data, text, n = F.col("data"), F.col("data").cast("string"), F.octet_length("data")
    place = file_of(record_id(data), files)
    made = pages.select(record(F.col("page_id"), F.col("url"), F.col("html")).alias("data"), F.lit(1).alias("copies"))
    ours = staged(pack(made.select(place.alias("file_id"), "data", "copies")), "replica", paths)
    draw = F.when(_page(data) == "", 0).otherwise(F.conv(F.substring(F.md5(_page(data)), 1, 6), 16, 10).cast("long"))
    each = ours.select("data", F.lit(1).alias("copies"), draw.alias("draw"), place.alias("place"))
    changed = F.concat(F.substring(text, 1, 9), F.lit("R"), F.substring(text, 11, 1 << 30))
    fault = F.when(F.col("draw") % 101 == 7, F.substring("data", F.lit(1), n - 10)).when(F.col("draw") % 103 == 9, changed.cast("binary")).otherwise(data)
    kept = each.filter("draw % 211 <> 5").select(((F.col("place") + F.when(F.col("draw") % 223 == 6, 1).otherwise(0)) % files).alias("file_id"), fault.alias("data"), "copies")
    more = record(F.concat(F.lit("x"), record_id(data)), F.lit(""), F.lit("extra"))
    added = each.filter("draw % 227 = 8").select(F.col("place").alias("file_id"), more.alias("data"), "copies")
    return ours, staged(pack(kept.unionByName(added)), "replica", paths)


def audited(pages: DataFrame, per_file: int = FILE_RECORDS) -> DataFrame:
    """``audit`` of two replicas of ``pages``, with the page_id that the record's bytes name."""
    made: list[str] = []
    found = audit(*replicas(pages, per_file, made))
    discard(pages.sparkSession, made)  # the trees hold all that is reported
    return found.withColumn("page_id", F.regexp_extract("record_id", r"^(-?[0-9]{1,19}):", 1).try_cast("long"))


def oracle() -> str:
    """The same in DuckDB: layouts by running sums, ids and lengths read from the records, trees by grouping, faults by comparing all records."""
    rec = lambda i, u, h: f"""'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || {u} || chr(13) || chr(10) || '{MARK}' || {i} || ':' || md5({u} || chr(10) || {h}) || '>' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen({h}) || chr(13) || chr(10) || chr(13) || chr(10) || {h} || chr(13) || chr(10) || chr(13) || chr(10)"""
    name = "regexp_extract(split_part({0}, chr(13) || chr(10) || chr(13) || chr(10), 1), 'WARC-Record-ID: <urn:page:([^>]*)>', 1)"
    file = "CAST('0x' || substr(md5({0} || '/'), 1, 8) AS BIGINT) % (SELECT n FROM files)"
    ctes = []
    for side, source in (("a", "SELECT file_id, data FROM ours"), ("b", "SELECT file_id, data FROM theirs")):
        ctes.append(f"""{side}laid AS (SELECT *, strlen(data) AS length, CAST(sum(strlen(data)) OVER (PARTITION BY file_id ORDER BY path, sha ROWS UNBOUNDED PRECEDING) - strlen(data) AS BIGINT) AS start
  FROM (SELECT file_id, data, {name.format("data")} AS id, md5({name.format("data")}) AS path, sha256(data) AS sha FROM ({source})))""")
        ctes.append(f"""{side}{LEVELS + 1} AS (SELECT file_id, path AS key, sha AS hash, start, start + length AS stop FROM {side}laid)""")
        for d in range(LEVELS, -1, -1):
            below = f"{side}{d + 1}"
            ctes.append(f"""{side}{d} AS (SELECT file_id, key, sha256(string_agg(hash || ':' || (start - first) || ':' || (stop - start), ',' ORDER BY start, hash) || '|' || (any_value(last) - any_value(first))) AS hash, any_value(first) AS start, any_value(last) AS stop
  FROM (SELECT file_id, substr(key, 1, {d}) AS key, hash, start, stop, min(start) OVER w AS first, max(stop) OVER w AS last FROM {below} WINDOW w AS (PARTITION BY file_id, substr(key, 1, {d}))) GROUP BY file_id, key)""")
    head = "split_part(b.data, chr(13) || chr(10) || chr(13) || chr(10), 1)"
    return f"""
WITH plain AS (SELECT coalesce(CAST(page_id AS VARCHAR), '') AS page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, coalesce(CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 6) AS BIGINT), 0) AS draw FROM pages),
made AS (SELECT draw, CAST(count(*) AS BIGINT) AS copies, data FROM (SELECT draw, {rec("page_id", "url", "html")} AS data FROM plain) GROUP BY ALL),
files AS (SELECT greatest(1, CAST(ceil(count(*) / {FILE_RECORDS}.0) AS BIGINT)) AS n FROM pages),
ours AS (SELECT {file.format(name.format("data"))} AS file_id, data FROM made),
theirs AS (
  SELECT ({file.format(name.format("data"))} + CASE WHEN draw % 223 = 6 THEN 1 ELSE 0 END) % (SELECT n FROM files) AS file_id,
    CASE WHEN draw % 101 = 7 THEN left(data, length(data) - 10) WHEN draw % 103 = 9 THEN substr(data, 1, 9) || 'R' || substr(data, 11) ELSE data END AS data FROM made WHERE draw % 211 <> 5
  UNION ALL SELECT {file.format(name.format("data"))}, {rec("'x' || " + name.format("data"), "''", "'extra'")} FROM made WHERE draw % 227 = 8),
{", ".join(ctes)},
met AS (SELECT coalesce(a.id, b.id) AS record_id, a.file_id, a.start AS record_offset, a.length AS record_length, a.sha AS record_sha256, b.file_id AS replica_file_id, b.start AS replica_offset, b.length AS replica_length, b.sha AS replica_sha256,
  b.length = strlen({head}) + TRY_CAST(regexp_extract({head}, 'Content-Length: ([0-9]+)', 1) AS BIGINT) + 8 AS well_formed,
  CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'extra' WHEN a.sha <> b.sha THEN 'damaged' WHEN a.file_id <> b.file_id THEN 'moved' ELSE 'intact' END AS status
  FROM alaid a FULL JOIN blaid b ON a.id = b.id)
SELECT met.*, a0.hash AS root_sha256, b0.hash AS replica_root_sha256, TRY_CAST(regexp_extract(record_id, '^(-?[0-9]+):', 1) AS BIGINT) AS page_id, coalesce(copies, 0) AS copies
FROM met LEFT JOIN a0 ON a0.file_id = coalesce(met.file_id, met.replica_file_id) LEFT JOIN b0 ON b0.file_id = coalesce(met.file_id, met.replica_file_id)
LEFT JOIN (SELECT {name.format("data")} AS name, copies FROM made) m ON m.name = met.record_id"""
