"""Files named after their key, written and read back."""

from pyspark.sql import functions as F

from tessera.sources import files as FS


def test_key_is_the_file_name(spark, tmp_path):
    rows = [("Côte d'Ivoire", 2, "b"), ("Côte d'Ivoire", 1, "a"), ("a/b c+d=e%", 1, "x"), ("plain", 1, "")]
    path = str(tmp_path / "keyed")
    FS.write_keyed_text(spark.createDataFrame(rows, "k string, line_no int, text string"), "k", path)
    names = sorted(f.name for f in (tmp_path / "keyed").iterdir() if not f.name.startswith("."))
    assert len(names) == 3 and "plain.txt" in names
    back = FS.read_dir_files(spark, path, "country", encoded=True)
    assert {r.country: r.value.split("\n")[:2] for r in back.where(F.col("country") != "plain").collect()} == {
        "Côte d'Ivoire": ["a", "b"], "a/b c+d=e%": ["x", ""]}
    assert FS.read_dir_lines(spark, path, "country", encoded=True).groupBy("country").count().count() == 3
    # files of others: the name as it is
    other = tmp_path / "other" / "deep"
    other.mkdir(parents=True)
    for name in ("Côte d'Ivoire.txt", "a+b c%41.txt", "skipped.csv"):
        (other / name).write_text("one\ntwo\n")
    assert {r.k for r in FS.read_dir_lines(spark, str(tmp_path / "other"), "k").collect()} == {"Côte d'Ivoire", "a+b c%41"}
