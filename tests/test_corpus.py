from rulespark.sources.rules import resolve_includes


def test_long_includes(spark):
    files = spark.createDataFrame([(f"f{k}", f'include "f{k + 1}"') for k in range(34)], "path string, text string")
    assert resolve_includes(files).filter("src = 'f0'").count() == 34
