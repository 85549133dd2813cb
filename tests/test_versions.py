import os

import pytest

from shopstat.sources import versions as V


def _seen(spark, root):
    return V.read_current(spark, root).count()


def test_reader_sees_old_or_new_at_every_stop(spark, tmpdir_path, monkeypatch):
    root = os.path.join(tmpdir_path, "t")
    assert V.current(spark, root) is None
    with pytest.raises(ValueError, match="no version"):
        V.read_current(spark, root)
    V.publish(spark.range(5), root)
    bad = spark.range(5).selectExpr("CAST(concat('x', id) AS INT) AS id")
    with pytest.raises(Exception):
        V.publish(bad, root)                                   # stopped while rows are written
    assert _seen(spark, root) == 5

    def stop(*_):
        raise OSError("stopped")
    for step, rows in (("_mark", 5), ("_forget", 7)):          # stopped before and after the last step
        with monkeypatch.context() as m:
            m.setattr(V, step, stop)
            with pytest.raises(OSError):
                V.publish(spark.range(7), root)
        assert _seen(spark, root) == rows
    deleted = []
    with monkeypatch.context() as m:                           # stopped at each deletion in turn
        m.setattr(V, "delete", lambda s, p: deleted.append(p) or stop())
        for n in (8, 9, 10):
            try:
                V.publish(spark.range(n), root)
            except OSError:
                pass
            assert _seen(spark, root) == n
    assert deleted
    V.publish(V.read_current(spark, root).filter("id < 3"), root)        # rows of the old version itself
    assert _seen(spark, root) == 3
    assert len(V.names_in(spark, f"{root}/published")) == V.KEPT == len(V.names_in(spark, f"{root}/versions"))


def test_plain_read_of_the_root_gives_no_mixture(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "t")
    for n in (2, 3):
        V.publish(spark.range(n), root)
    with pytest.raises(Exception):
        spark.read.parquet(root).count()


def test_catalogue_name_moves_in_one_step(spark, tmpdir_path, monkeypatch):
    name, sql = "default.versioned_tbl", type(spark).sql
    first = V.publish_table(spark.range(4), name, ["id"], 2, tmpdir_path)

    def stopped(self, text, *a, **k):
        if text.startswith("CREATE OR REPLACE VIEW"):
            raise OSError("stopped")
        return sql(self, text, *a, **k)
    with monkeypatch.context() as m:
        m.setattr(type(spark), "sql", stopped)
        with pytest.raises(OSError):
            V.publish_table(spark.range(9), name, ["id"], 2, tmpdir_path)
    assert spark.table(name).count() == 4 and V.current_table(spark, name) == first
    second = V.publish_table(spark.range(6).selectExpr("id", "id AS more"), name, ["id"], 2, tmpdir_path)
    assert spark.table(name).columns == ["id", "more"] and spark.table(name).count() == 6
    left = {t.name for t in spark.catalog.listTables("default") if t.name.startswith("versioned_tbl__v")}
    assert left == {first.split(".")[1], second.split(".")[1]}          # the abandoned one is gone
    spark.sql(f"DROP VIEW {name}")
    for t in left:
        spark.sql(f"DROP TABLE {t}")


def test_a_plain_table_is_not_overwritten(spark, tmpdir_path):
    spark.range(2).write.mode("overwrite").saveAsTable("plain_tbl")
    with pytest.raises(ValueError, match="is a table"):
        V.publish_table(spark.range(3), "plain_tbl", ["id"], 2)
    assert spark.table("plain_tbl").count() == 2
    spark.sql("DROP TABLE plain_tbl")
