import os
import tempfile

from eraspark.sources.tables import SONGS_SCHEMA, require_columns, scan_songs_csv, songs


def test_csv_multiline_quotes(spark):
    d = tempfile.mkdtemp(prefix="eraspark-csv-")
    p = os.path.join(d, "songs.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write('id,title,lyrics,language,year,views,tag\n')
        f.write('1,"A ""quoted"" title","line one\nline two",en,1990,10,pop\n')
        f.write('2,NA,"single",en,,,rock\n')
        f.write('3,"t3","x, y\n\nz",fr,2001,5,rap\n')
    df = scan_songs_csv(spark, p)
    rows = {r.id: r for r in df.collect()}
    assert len(rows) == 3
    assert rows[1].title == 'A "quoted" title' and rows[1].lyrics == "line one\nline two"
    assert rows[2].title == "NA" and rows[2].year is None
    assert df.schema == SONGS_SCHEMA


def test_require_columns(spark):
    from conftest import SF001
    import pytest
    s = songs(spark, SF001)
    assert require_columns(s, ["lyrics", "tag"]) is s
    with pytest.raises(ValueError):
        require_columns(s.drop("tag"), ["lyrics", "tag"])


def test_scan_pushes_filters(spark):
    from conftest import SF001
    from eraspark.operators.corpus import clean_stage
    plan = clean_stage(songs(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
