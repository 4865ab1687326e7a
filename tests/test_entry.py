import __spark_entry__ as e


def test_catalogue(spark, data):
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
    assert e.entry(spark).columns == ["table_name", "field_name", "ref_month", "orphan_kind", "n_keys", "n_refs"]


def test_core_imports_without_llm():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(e.__file__).parent
    code = "import sys\nclass B:\n    def find_spec(self, n, p=None, t=None):\n        if n.startswith('loomtrace.llm'): raise ModuleNotFoundError(n, name=n)\nsys.meta_path.insert(0, B())\nimport __spark_entry__ as e\nq = e.queries()\nassert 'p6_found' in q and 'p2_found' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
