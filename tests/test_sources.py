"""Delimited reader edge cases: quoting, encoding, null tokens, positions."""

from microstar.sources.delimited import read_delimited


def test_quoted_separator_escaped_quote_latin1_and_nulls(spark, tmp_path):
    path = tmp_path / "f.csv"
    with open(path, "w", encoding="iso-8859-1") as fh:
        fh.write("a;b;c\n")                                        # header names are ignored
        fh.write('1;"São Paulo; SP";"say ""hi"""\n')
        fh.write('2;  - ;""\n')
        fh.write("\n")
        fh.write("3;Brasília;x\n")
    rows = read_delimited(spark, str(path), ["ID", "NAME", "NOTE"], sep=";").orderBy("ID").collect()
    assert [tuple(r) for r in rows] == [("1", "São Paulo; SP", 'say "hi"'), ("2", None, None),
                                        ("3", "Brasília", "x")]


def test_comma_layout_and_extra_columns_are_positional(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text("x,y\n10,20\n11,21\n", encoding="iso-8859-1")
    df = read_delimited(spark, str(path), ["FIRST", "SECOND"], sep=",")
    assert df.columns == ["FIRST", "SECOND"]
    assert sorted(tuple(r) for r in df.collect()) == [("10", "20"), ("11", "21")]


def test_overflow_sentinel_flags_shifted_lines(spark, tmp_path):
    from microstar.plans import exam
    from microstar.operators.quality import split_rejects
    from tests import exam_fixtures as X
    path = X.write_raw(str(tmp_path), 2019, X.rows_2019()[:2])
    with open(path, "a", encoding="iso-8859-1") as fh:               # an unquoted ';' inside a name
        row = X.base_row(2019, "190000000077")
        row["NO_MUNICIPIO_PROVA"] = "Boa Vista;RR"
        fh.write(";".join(row.get(c, "") or "" for c in X.LAYOUTS[2019]) + "\n")
    checked = exam.check_raw(exam.read_raw(spark, path, 2019, flag_overflow=True), 2019)
    good, bad = split_rejects(checked)
    assert "_EXTRA_FIELDS" not in good.columns
    assert sorted(r["NU_INSCRICAO"] for r in good.collect()) == ["190000000001", "190000000002"]
    assert [(r["NU_INSCRICAO"], r["_reject_reason"]) for r in bad.collect()] == \
        [("190000000077", exam.MALFORMED)]


def test_cells_of_a_wide_file_are_cleaned_in_one_projection(spark, tmp_path):
    """A cell is trimmed and nulled by one expression: no further copy of the wide row."""
    (tmp_path / "w.csv").write_text("a;b\n1; - \n;\"  \"\n 2 ;x-\n")
    wide = read_delimited(spark, str(tmp_path / "w.csv"), ["A", "B"])
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Project") == 1 and "_common_expr" not in plan
    assert [tuple(r) for r in wide.collect()] == [("1", None), (None, None), ("2", "x-")]
