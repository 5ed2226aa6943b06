"""Command line: load editions into the star, or analyse an exported star.

    python -m microstar load --edition 2019=/data/MICRODADOS_2019.csv \\
        --edition 2018=/data/MICRODADOS_2018.csv --out /lake/exam [--state RR] [--fixes]
    python -m microstar municipality --list /data/municipios.csv --out /lake/municipality
    python -m microstar analyse --star /lake/export --report /lake/report

``load`` writes raw/, cleaned/ (one folder per edition) and curated/
(star tables partitioned by ANO_ENEM, plus rejects).  ``analyse`` reads the
tab-separated star export (cadastral, ensino, presenca, local, socio,
municipio, nota sub-folders), profiles the joined table, fits and evaluates
the grade model and writes the profile, the evaluation tables and the model
terms as Parquet; the hit rates are printed.
"""

from __future__ import annotations

import argparse
import json
import sys


def _editions(items: list[str]) -> dict[int, str]:
    out = {}
    for item in items:
        year, _, path = item.partition("=")
        out[int(year)] = path
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="microstar")
    sub = parser.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("load", help="raw editions -> RAW, CLEANED, CURATED star")
    p.add_argument("--edition", action="append", required=True, help="YEAR=PATH (file or folder)")
    p.add_argument("--out", required=True)
    p.add_argument("--state", default="RR", help="exam state to keep; empty string keeps all")
    p.add_argument("--fixes", action="store_true", help="correct the reference's known quirks")
    p.add_argument("--table", action="append", help="load only this star table (repeatable)")
    m = sub.add_parser("municipality", help="municipality list -> RAW, CLEANED, CURATED")
    m.add_argument("--list", required=True, help="delimited text, file or folder")
    m.add_argument("--out", required=True)
    m.add_argument("--sep", default=";")
    a = sub.add_parser("analyse", help="star export -> model, evaluation, hit rates")
    a.add_argument("--star", required=True)
    a.add_argument("--report", required=True)
    args = parser.parse_args(argv)

    from microstar.session import get_spark
    spark = get_spark(app=f"microstar-{args.cmd}")
    if args.cmd == "load":
        from microstar.plans import exam
        paths = exam.load_editions(spark, _editions(args.edition), args.out, state=args.state or None,
                                  fixes=args.fixes, tables=args.table)
        print(json.dumps(paths))
        return 0
    if args.cmd == "municipality":
        from microstar.plans.municipality import load_municipality
        print(json.dumps(load_municipality(spark, args.list, args.out, args.sep)))
        return 0
    from microstar.plans import analysis as A
    tables = A.read_star(spark, args.star)
    joined = A.join_star(tables)
    for part, frame in A.profile(joined).items():
        if frame is not None:
            frame.write.mode("overwrite").parquet(f"{args.report}/profile/{part}")
    ev = A.fit_and_evaluate(spark, joined)
    ev.holdout.write.mode("overwrite").parquet(f"{args.report}/holdout")
    ev.scored.write.mode("overwrite").parquet(f"{args.report}/scored")
    ev.model.to_frame(spark).write.mode("overwrite").parquet(f"{args.report}/model")
    rates = {"holdout": ev.holdout_hit_rate.first()[0], "scored": ev.scored_hit_rate.first()[0]}
    print(json.dumps(rates))
    return 0


if __name__ == "__main__":
    sys.exit(main())
