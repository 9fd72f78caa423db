"""Tags and chapters as ;FFMETADATA1 text, written and parsed in column functions, and attachments as files beside them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = ";FFMETADATA1"
#: A line: escaped characters (also line ends) or any others up to a line end.
_LINE = r"((?:\\[\s\S]|[^\\\n])*)(?:\n|$)"
_PAIR = r"^((?:\\[\s\S]|[^\\=])*)=([\s\S]*)$"


def escaped(s: Column) -> Column:
    """``=``, ``;``, ``#``, backslashes and line ends get a backslash before them."""
    return F.regexp_replace(s, r"([=;#\\\n])", r"\\$1")


def unescaped(s: Column) -> Column:
    return F.regexp_replace(s, r"\\([\s\S])", "$1")


def text(tags: Column, chapters: Column) -> Column:
    """The file of tags (a map; null values are left out) and chapters (an array of structs start_ms, end_ms, title). Tags
    are in order of their names."""
    names = F.array_sort(F.map_keys(F.map_filter(F.coalesce(tags, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())))
    pairs = F.transform(names, lambda k: F.concat(escaped(k), F.lit("="), escaped(tags[k]), F.lit("\n")))

    def chapter(c: Column) -> Column:
        title = F.when(c["title"].isNotNull(), F.concat(F.lit("title="), escaped(c["title"]), F.lit("\n"))).otherwise("")
        return F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), c["start_ms"].cast("string"), F.lit("\nEND="), c["end_ms"].cast("string"), F.lit("\n"), title)

    return F.concat(F.lit(HEAD + "\n"), F.array_join(pairs, ""), F.array_join(F.coalesce(F.transform(chapters, chapter), F.array().cast("array<string>")), ""))


def parse(files: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, tags, chapters) of each file's ``value``; of equal tags the last one counts. Comments and other sections are
    passed over; chapters in another time base are rescaled to milliseconds. A text without the head line has neither: both
    are null."""
    good = F.substring("value", 1, len(HEAD)) == HEAD
    lines = files.select(*keep, F.coalesce(good, F.lit(False)).alias("_good"), F.regexp_extract_all(F.coalesce("value", F.lit("")), F.lit(_LINE), F.lit(1)).alias("_l"))
    heads = F.filter(F.transform("_l", lambda x, i: F.when(x.rlike(r"^\[[A-Z]+\]$"), i)), lambda i: i.isNotNull())
    cut = lines.withColumn("_at", heads)
    cut = cut.withColumn("_at", F.concat(F.col("_at"), F.array(F.size("_l"))))
    section = lambda a, b: F.slice("_l", a + 1, b - a)  # noqa: E731  lines a .. b - 1, from 0
    is_pair = lambda x: x.rlike(_PAIR) & ~x.rlike("^[;#]")
    key, value = (lambda x: unescaped(F.regexp_extract(x, _PAIR, 1))), (lambda x: unescaped(F.regexp_extract(x, _PAIR, 2)))
    pairs = lambda ls: F.transform(F.filter(ls, is_pair), lambda x: F.struct(key(x).alias("k"), value(x).alias("v")))
    again = lambda p, e, i: F.exists(F.slice(p, i + 2, F.size(p)), lambda o: o["k"] == e["k"])
    # A line is taken apart once: what is bound to p isn't evaluated again.
    as_map = lambda ls: F.get(F.transform(F.array(pairs(ls)), lambda p: F.map_from_entries(F.filter(p, lambda e, i: ~again(p, e, i)))), F.lit(0))
    numbers = F.sequence(F.lit(0), F.size("_at") - 2)
    sections = F.when(F.size("_at") > 1, F.transform(numbers, lambda i: section(F.get("_at", i), F.get("_at", i + 1)))).otherwise(F.array().cast("array<array<string>>"))
    maps = F.transform(F.filter(sections, lambda s: F.get(s, F.lit(0)) == "[CHAPTER]"), as_map)

    def chapter(m: Column) -> Column:
        base = F.split(F.coalesce(m["TIMEBASE"], F.lit("1/1000000000")), "/")
        ms = lambda c: F.round(m[c].cast("long") * 1000 * F.get(base, F.lit(0)).cast("long") / F.get(base, F.lit(1)).cast("long")).cast("long")
        return F.struct(ms("START").alias("start_ms"), ms("END").alias("end_ms"), m["title"].alias("title"))

    found = {"tags": as_map(section(F.lit(0), F.get("_at", F.lit(0)))), "chapters": F.transform(maps, chapter)}
    return cut.select(*keep, *(F.when(F.col("_good"), v).alias(c) for c, v in found.items()))


def write(files: DataFrame, folder: str, key: str, columns: dict[str, str]) -> DataFrame:
    """(key, path) of a file for each row and column: ``columns`` gives the end of the name of each (text or binary; a null
    writes nothing). A file appears under its name when it is whole."""
    kind, ends = files.schema[key].dataType.simpleString(), list(columns.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            made = []
            for name, *data in zip(*(c.to_pylist() for c in batch.columns)):
                for end, x in zip(ends, data):
                    if x is not None:
                        with store.open_output_stream(f"{root}/.{name}{end}.part") as out:
                            out.write(x.encode() if isinstance(x, str) else x)
                        store.move(f"{root}/.{name}{end}.part", f"{root}/{name}{end}")
                        made.append((name, f"{root}/{name}{end}"))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], batch.column(0).type), pa.array([m[1] for m in made], pa.string())], names=[key, "path"])

    return files.select(key, *columns).mapInArrow(run, f"`{key}` {kind}, path string")
