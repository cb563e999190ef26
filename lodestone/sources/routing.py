"""Which reader takes a file, and reading whole listings of files to chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.sources.formats import code, media, packages, texts
from lodestone.sources.formats.base import Chunk, File, Ocr

#: Families in the order in which they are asked; their suffixes don't overlap.
FAMILIES: dict[str, tuple[frozenset[str], Callable[[File], list[Chunk]]]] = {
    "pdf": (frozenset((".pdf",)), packages.pdf),
    "markdown": (texts.MARKDOWN, texts.markdown),
    "html": (texts.HTML, texts.html),
    "office": (packages.OFFICE, packages.office),
    "image": (media.IMAGES, media.image),
    "audio": (media.AUDIO, media.audio),
    "video": (media.VIDEO, media.video),
    "subtitles": (texts.SUBTITLES, texts.subtitles),
    "archive": (packages.ARCHIVES, packages.archive),
    "code": (frozenset(code.LANGUAGES), code.parse),
    "text": (texts.TEXT, texts.plain),
}
OTHER = "other"
_BY_SUFFIX = {s: name for name, (suffixes, _) in FAMILIES.items() for s in suffixes}


def family_of(suffix: str) -> str:
    return _BY_SUFFIX.get(suffix.lower(), OTHER)


def family(extension: Column) -> Column:
    """The family of a suffix, as a literal map in the plan."""
    out = F.lit(OTHER)
    for name, (suffixes, _) in FAMILIES.items():
        out = F.when(F.lower(extension).isin(sorted(suffixes)), name).otherwise(out)
    return out


def read_file(f: File) -> list[Chunk]:
    """Chunks by the file's reader; a file that gives none, or breaks its reader, is described by its name and place."""
    reader = FAMILIES.get(family_of(f.path.suffix), (None, media.anything))[1]
    try:
        chunks = [c for c in reader(f) if c.text.strip()]
    except Exception:  # noqa: BLE001  one bad file must not end a crawl
        chunks = []
    return chunks or media.anything(f)


PARSED = "doc_id long, chunk_id long, chunk_index int, text string, page_number int, section_title string, code_type string, symbol_name string, start_line int, end_line int, symbols array<struct<name:string,kind:string,line_number:int>>"


def with_companions(files: DataFrame) -> DataFrame:
    """files with `companions`: the subtitles in a video's folder whose names start with the video's."""
    ext, name = T.extension(F.col("path")), T.filename(F.col("path"))
    stem = F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
    folder = F.regexp_replace("path", r"[^/]*$", "")
    keyed = files.select("path", "content", folder.alias("folder"), stem.alias("stem"), ext.alias("ext"), name.alias("name"))
    videos = keyed.where(F.col("ext").isin(sorted(media.VIDEO))).select("path", "folder", F.col("stem").alias("video"))
    subs = keyed.where(F.col("ext").isin(sorted(texts.SUBTITLES))).select("folder", "stem", "name", "content")
    pairs = videos.join(subs, "folder").where(F.col("stem").startswith(F.col("video")))
    found = pairs.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("name", "content"))).alias("companions"))
    return files.join(found, "path", "left")


def read_files(files: DataFrame, ocr: Ocr | None = None) -> DataFrame:
    """PARSED rows. files: path, content, size_bytes, mtime (and companions, if any). ocr: reads pictures and scanned pages, on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                beside = tuple((c["name"], c["content"]) for c in (r.companions if r.companions is not None else ()))
                for n, c in enumerate(read_file(File(PurePosixPath(r.path), r.content or b"", int(r.size_bytes), float(r.mtime), beside, ocr))):
                    rows.append((r.doc_id, n, c.text, c.page_number, c.section_title, c.code_type, c.symbol_name, c.start_line, c.end_line, [vars(s) for s in c.symbols]))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text", "page_number", "section_title", "code_type", "symbol_name", "start_line", "end_line", "symbols"]).astype({"page_number": "Int32", "start_line": "Int32", "end_line": "Int32"})

    if "companions" not in files.columns:
        files = with_companions(files)
    ids = files.select(document_id(F.col("path")).alias("doc_id"), "path", "content", "size_bytes", "mtime", "companions")
    out = ids.mapInPandas(run, PARSED.replace("chunk_id long, ", ""))
    # Ids follow from path and place, so that indexing again gives them again.
    return out.withColumn("chunk_id", F.xxhash64("doc_id", "chunk_index"))


def document_id(path: Column) -> Column:
    return F.xxhash64(path)
