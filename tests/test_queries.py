import pytest

from tests.oracle import compare
from vigil.plans.catalog import registry

ALL = registry()


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in ALL.items() if sql))
def test_query_equals_sql(spark, name):
    f, sql = ALL[name]
    assert compare(spark, f, sql, "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in ALL.items() if not sql))
def test_query_without_sql_gives_rows(spark, name, sf):
    assert ALL[name][0](spark, sf).count() > 0


def test_entry_leaves_out_only_what_is_absent(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "find_spec", lambda name: None)
    assert set(entry.queries()) == set(ALL) and set(entry.oracle_sql()) < set(ALL)
    monkeypatch.setattr(entry, "find_spec", lambda name: name)

    def broken(name):
        raise ModuleNotFoundError("a dependency of the subpackage")

    monkeypatch.setattr(entry, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
