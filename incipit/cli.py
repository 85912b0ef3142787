"""Command line: convert PDF books to extracts, inspect their structure, search them."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import functions as F

from incipit.operators import evaluation, layout, retrieval, skill, structure
from incipit.scale import cut
from incipit.sources import pdf

OK, NOTHING, USAGE, LOW_COVERAGE = 0, 1, 2, 3
LEAST_COVERAGE = 0.2
LEAST_WORDS = 50


def detected(spark, path: str):
    """Structure of the book in a PDF file, and its title."""
    runs, fonts = (cut(t, "pdf") for t in pdf.scan(spark, path))
    blocks, _ = layout.build_blocks(cut(layout.group_lines(layout.measured(runs, fonts)), "lines"))
    meta = blocks.select("book").distinct().select("book", F.lit(None).cast("string").alias("title"), F.col("book").alias("stem"))
    return structure.detect(blocks), cut(structure.book_title(blocks, meta), "title")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="incipit", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, text in (("convert", "write an extract of each numbered chapter and an index"), ("inspect", "list chapters and sections"), ("search", "rank the book's chunks for a query")):
        p = sub.add_parser(name, help=text)
        p.add_argument("pdf")
        if name == "convert":
            p.add_argument("--out", default=".")
            p.add_argument("--source", help="author, publisher, licence")
            p.add_argument("--allow-low-coverage", action="store_true")
        if name == "search":
            p.add_argument("query")
            p.add_argument("-k", type=int, default=5)
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else OK
    if not Path(args.pdf).is_file() or getattr(args, "k", 1) < 1:
        print("no such file, or k below 1", file=sys.stderr)
        return USAGE
    from incipit.session import local_session

    spark = local_session()
    found, title = detected(spark, str(Path(args.pdf).resolve()))
    if args.command == "inspect":
        for r in structure.chapters(found).orderBy("chapter_no").collect():
            print(f"{r.label}  (page {r.page + 1}, {r.sections} sections)")
        return OK
    if args.command == "search":
        units = retrieval.chunk_sections(evaluation.section_pieces(found)).withColumn("doc", F.monotonically_increasing_id())
        units = cut(units, "units")
        hits = retrieval.bm25_topk(spark.createDataFrame([("q", args.query)], "qid string, query string"), units, args.k).join(units.select("doc", "uid", "text"), "doc").orderBy("rank").collect()
        for r in hits:
            print(f"{r['rank']}. {r.uid}  {r.score:.3f}\n   {' '.join(r.text.split())[:300]}")
        return OK if hits else NOTHING
    words = structure.content(found).agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    if words < LEAST_WORDS:
        print("hardly any text: a scanned book?", file=sys.stderr)
        return USAGE
    if structure.coverage(found).first().coverage < LEAST_COVERAGE and not args.allow_low_coverage:
        print("few of the words are in numbered chapters", file=sys.stderr)
        return LOW_COVERAGE
    refs = cut(skill.references(found), "references")
    top = skill.index(refs, title, args.source).first()
    if top is None:
        print("no numbered chapters", file=sys.stderr)
        return USAGE
    print(skill.write(top.name, top.markdown, {r.file: r.markdown for r in refs.select("file", "markdown").collect()}, args.out))
    return OK


if __name__ == "__main__":
    sys.exit(main())
