"""Files at the edge: attachments as text, tables for spreadsheets and reports, texts without names, ages of files."""

from __future__ import annotations

import html
import io as bytes_io
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.sources import connectors, pdf

#: Partitions of small files that one task reads.
TOGETHER = 64
#: Where documents in zip files keep their text.
INSIDE = {"docx": "word/document.xml", "odt": "content.xml"}
_CONTROL = re.compile(r"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\(.)|([{}])|([^\\{}\r\n]+)", re.S)
#: Groups of a rich text that show nothing, and words that stand for a character.
UNSEEN = frozenset("fonttbl colortbl stylesheet info pict header footer".split())
CHARACTERS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}


def rich_text(data: bytes) -> str:
    """Words of an RTF file: bytes of its code page, characters by number (and what stands in for them left out), no tables of fonts."""
    source = data.decode("latin-1")
    page = re.search(r"\\ansicpg(\d+)", source)
    page = f"cp{page[1]}" if page else "cp1252"
    try:
        "".encode(page)
    except LookupError:
        page = "cp1252"
    out: list[str] = []
    seen, skipped, instead, shown = [], 0, 1, True
    for m in _CONTROL.finditer(source):
        code, word, number, sign, brace, plain = m.groups()
        if brace == "{":
            seen.append((shown, instead))
        elif brace:
            shown, instead = seen.pop() if seen else (True, 1)
            skipped = 0
        elif sign == "*":
            shown = False
        elif word:
            if word in UNSEEN:
                shown = False
            elif word == "uc" and number:
                instead = int(number)
            elif shown and word == "u" and number:
                out.append(chr(int(number) % 65536))
                skipped = instead
            elif shown and word in CHARACTERS:
                out.append(CHARACTERS[word])
        elif shown:
            new = bytes.fromhex(code).decode(page, "replace") if code else {"~": " ", "_": "-", "-": "", "\n": "\n", "\r": "\n"}.get(sign, sign) if sign else plain
            out.append(new[skipped:])
            skipped = max(0, skipped - len(new))
    text = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # halves of a character meet
    return re.sub(r"[^\S\n]+", " ", text).strip()




def text_of(name: str, data: bytes) -> tuple[str | None, str]:
    """The text of a file and how it was read: text, html, docx, odt, rtf, pdf, or why not: damaged, locked, unknown."""
    ending = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if ending in ("txt", "md", "csv"):
        return data.decode("utf-8", "replace"), "text"
    if ending in ("html", "htm"):
        return html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"(?s)<(script|style)\b.*?</\1>", " ", data.decode("utf-8", "replace")))).strip(), "html"
    if ending in INSIDE:
        try:
            root = ElementTree.fromstring(zipfile.ZipFile(bytes_io.BytesIO(data)).read(INSIDE[ending]))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None, "damaged"
        paragraphs = [x for x in root.iter() if x.tag.rsplit("}", 1)[-1] in ("p", "h")]
        return "\n".join("".join(p.itertext()) for p in paragraphs), ending
    if ending == "rtf":
        return rich_text(data), "rtf"
    if ending == "pdf":
        try:
            return pdf.text(data), "pdf"
        except pdf.Damaged as e:
            return None, str(e)
    return None, "unknown"


def attachments(spark: SparkSession, path: str) -> DataFrame:
    """path, modified, text, how of the files below a folder. Files are read by Spark; each is unpacked by itself in the task. Spark counts a small file
    as 4 MB and puts some thirty of them into a partition: a task takes ``TOGETHER`` such partitions, one after the other."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("modified"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_of(p, d or b"") for p, d in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("modified"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], ["path", "modified", "text", "how"])

    most, cores = rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    rows = rows.coalesce(max(1, min(most, max(2 * cores, -(-most // TOGETHER)))))
    return rows.mapInArrow(run, "path string, modified timestamp, text string, how string")


def page_of(text: str) -> bytes:
    """A text as a page of HTML."""
    return f"<html><head><style>p {{}}</style></head><body><p>{html.escape(text)}</p></body></html>".encode()


def write_files(rows: DataFrame, name: str, text: str, path: str, make: Callable[[str], bytes] | Mapping[object, Callable[[str], bytes]], kind: str | None = None) -> int:
    """A file for each row, made by its task, and how many there are. A repeated task writes the same files again. A name may begin with folders. With a
    column ``kind``, make has a function for each of its values."""
    names = rows.select(F.col(name).alias("name"), F.col(text).alias("text"), (F.col(kind) if kind else F.lit(0)).alias("kind"))
    makers = make if kind else {0: make}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = connectors.opened(path)
        there = set()
        for batch in batches:
            for n, t, k in zip(*(batch.column(c).to_pylist() for c in ("name", "text", "kind")), strict=True):
                folder, _, own = f"{at}/{n}".rpartition("/")
                if folder not in there:
                    system.create_dir(folder, recursive=True)
                    there.add(folder)
                with system.open_output_stream(f"{folder}/{own}") as f:
                    f.write(makers[k](t))
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    return names.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def old_files(spark: SparkSession, path: str, now: Column, days: int) -> DataFrame:
    """ending, n and bytes of the files older than so many days: what a clean-up would move. Contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    old = rows.where(F.col("modificationTime") < now - F.make_dt_interval(F.lit(days)))
    return old.groupBy(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ending")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def flat(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so a table fits into a sheet or a CSV file."""
    nested = ("array", "map", "struct")
    return rows.select(*[F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in rows.dtypes])


def write_sheet(rows: DataFrame, path: str) -> None:
    flat(rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def grading_sheet(grades: DataFrame, integrity: DataFrame, keys: list[str]) -> DataFrame:
    """All grades, with what is known of the text beside them, flat."""
    return flat(grades.join(integrity, keys, "left"))


def rationales(rows: DataFrame, name: str, key: str, grade: str, flags: str) -> DataFrame:
    """name, id, grade, reason: what a rationale file holds."""
    return rows.select(F.col(name).alias("name"), F.col(key).alias("id"), F.col(grade).alias("grade"), F.when(F.size(flags) > 0, F.array_join(flags, "; ")).otherwise("meets all requirements").alias("reason"))


def flag_book(flags: DataFrame, student: str, day: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Summary (student, n, last, kinds), most flags first, and details, latest first."""
    summary = flags.groupBy(student).agg(F.count("*").alias("total_flags"), F.max(day).alias("last"), F.array_join(F.array_sort(F.collect_set(kind)), ", ").alias("kinds"))
    return summary.orderBy(F.desc("total_flags"), student), flags.orderBy(F.desc(day), student)


def level_report(rows: DataFrame, level: str, outlier: Column) -> DataFrame:
    """level, n, share (percent) and n_outliers, and bar: ten signs for the whole."""
    out = rows.groupBy(level).agg(F.count("*").alias("n"), F.count_if(outlier).alias("n_outliers"))
    total = rows.agg(F.count("*").alias("total"))
    out = out.join(F.broadcast(total))  # one row
    share = 100.0 * F.col("n") / F.col("total")
    return out.select(level, "n", share.alias("share"), "n_outliers", F.rpad(F.repeat(F.lit("#"), F.round(share / 10).cast("int")), 10, ".").alias("bar"))


def student_report(key: Column, level: Column, score: Column, words: Column) -> Column:
    """One line of a text report."""
    return F.format_string("%-12s %-10s %6.2f %6d words", key.cast("string"), level, score, words.cast("long"))


def without_names(rows: DataFrame, group: str, text: str, names: DataFrame, name: str, alias: str) -> DataFrame:
    """rows with every name of their group replaced by its alias, whole words, case aside, longest names first. The names of a group (of a
    class: tens) are folded over each of its texts."""
    escaped = lambda c: F.regexp_replace(c, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    pairs = names.where(F.length(F.trim(name)) > 0).groupBy(group).agg(F.array_sort(F.collect_set(F.struct((-F.length(name)).alias("n"), F.concat(F.lit(r"(?iu)(?<![\p{L}0-9])"), escaped(F.col(name)), F.lit(r"(?![\p{L}0-9])")).alias("p"), F.col(alias).alias("a")))).alias("_names"))
    out = rows.join(pairs, group, "left")
    clean = F.aggregate("_names", F.col(text), lambda t, x: F.regexp_replace(t, x["p"], x["a"]))
    return out.withColumn(text, F.when(F.col("_names").isNotNull(), clean).otherwise(F.col(text))).select(*rows.columns)


def as_booleans(rows: DataFrame, columns: list[str]) -> DataFrame:
    """'true' in any case is true, anything else false, null stays null."""
    return rows.withColumns({c: F.lower(F.trim(F.col(c).cast("string"))) == "true" for c in columns})


def component_lines(counts: DataFrame, group: str, component: str, n: str) -> DataFrame:
    """group and lines: "component: n", by name, for an export of a quick analysis."""
    line = F.struct(F.col(component).alias("c"), F.concat_ws(": ", component, F.format_number(n, 0)).alias("l"))
    return counts.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n").alias("lines"))


def cached_age(rows: DataFrame, checked: str, now: Column, days: int, checksum: str, known: DataFrame, name: str) -> DataFrame:
    """name, is_stale (last looked at more than so many days ago) and changed (the checksum is not the known one)."""
    k = known.select(name, F.col(checksum).alias("_known"))
    out = rows.join(k, name, "left")
    return out.select(name, (F.col(checked).isNull() | (F.datediff(now, checked) > days)).alias("is_stale"), (~F.col(checksum).eqNullSafe(F.col("_known"))).alias("changed"))


def append(rows: DataFrame, path: str, **fields: object) -> None:
    """Telemetry and logs: rows at the end of a table, with the fields of the event. A repeated task leaves one copy: Spark commits a job's files together."""
    rows.withColumns({k: F.lit(v) for k, v in fields.items()}).write.mode("append").parquet(path)


def bar(share: Column, width: int = 10) -> Column:
    """A share of 0 to 1 as signs."""
    return F.rpad(F.repeat(F.lit("#"), F.round(share * width).cast("int")), width, ".")


def marker_text(counts: Column) -> Column:
    """"a (2), b (1)" of a map of counts, by name."""
    entries = F.array_sort(F.map_entries(counts))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(" ("), e["value"].cast("string"), F.lit(")"))), ", ")


def demo_cohort(spark: SparkSession, n: int, runs: int) -> DataFrame:
    """student, run, words, register: a class for demonstrations, the same each time, from arithmetic alone."""
    i = F.col("id")
    names = F.array(*map(F.lit, ("analytical", "personal", "reflective", "urgent")))
    rows = spark.range(n * runs).select((i % n).alias("student"), F.floor(i / n).alias("run"), (80 + (i * 7919 + 13) % 400).alias("words"), F.get(names, ((i * 31) % 4).cast("int")).alias("register"))
    return rows
