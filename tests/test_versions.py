"""Published sinks: a rerun that fails at any point leaves the earlier result readable."""

import pytest

from stepwright.sources import json_files, versions

SCHEMA = "id bigint, part string"


def rows(spark, n):
    return spark.range(n).selectExpr("id", "if(id % 2 = 0, 'even', 'odd') as part")


def ids(spark, table):
    return sorted(r.id for r in spark.read.schema(SCHEMA).json(versions.published(spark, table)).collect())


def test_a_rerun_replaces_and_may_read_what_it_replaces(spark, tmp_path):
    table = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.published(spark, table)
    assert versions.publish_json_lines(rows(spark, 5), table) == 1
    before = spark.read.schema(SCHEMA).json(versions.published(spark, table))
    assert versions.publish_json_lines(before.where("id > 2"), table) == 2
    assert ids(spark, table) == [3, 4]
    assert before.count() == 5  # whoever reads the old version may go on


@pytest.mark.parametrize("step", ["rows", "half", "record"])
def test_a_failure_leaves_the_old_result(spark, tmp_path, monkeypatch, step):
    table = str(tmp_path / "t")
    versions.publish_json_lines(rows(spark, 4), table)

    def fails(df, folder):
        if step == "half":
            json_files.write_json_lines(df.limit(1), folder)
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        if step == "record":  # rows are whole; the record is begun but never marked complete
            def begun(found, name):
                (tmp_path / "t" / "_published" / "record-00000002-0").mkdir()
                raise OSError("lost")

            m.setattr(versions.json, "dumps", lambda x: begun(x, None))
            versions.publish_json_lines(rows(spark, 9), table)
        else:
            versions.publish(rows(spark, 9), table, fails)
    assert ids(spark, table) == [0, 1, 2, 3]
    assert versions.publish_json_lines(rows(spark, 2), table) == 2
    assert ids(spark, table) == [0, 1]
    versions.remove_superseded(spark, table)
    assert ids(spark, table) == [0, 1]
    assert len(list((tmp_path / "t").glob("rows-*"))) == len(list((tmp_path / "t" / "_published").glob("record-*"))) == 1


def test_folders_by_value_and_kept_versions(spark, tmp_path):
    table = str(tmp_path / "t")
    for n in (2, 4, 6):
        versions.publish_by_file(rows(spark, n), table, "part")
    assert versions.remove_superseded(spark, table, keep=2) == 2
    assert ids(spark, table) == list(range(6))
    assert len(list((tmp_path / "t").glob("rows-*"))) == 2
    assert versions.publish_by_file(rows(spark, 0), table, "part") == 4
    assert ids(spark, table) == []
