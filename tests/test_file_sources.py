"""CSV files with differing headers in one scan."""
import pytest

from spreadlens.sources import files as S


def put(root, name, text):
    root.mkdir(parents=True, exist_ok=True)
    (root / name).write_text(text)


def test_every_text_candidate(spark, tmp_path):
    """All nine names, in order of preference, with and without an id column; quoted line ends; other files left out."""
    want = set()
    for i, name in enumerate(S.TEXT_CANDIDATES):
        later = S.TEXT_CANDIDATES[i + 1:]
        put(tmp_path, f"site{i}_{'fake' if i % 2 else 'real'}.csv", ",".join([*later, "url", name, "id"]) + "\n"
            + "".join(",".join([*("no" for _ in later), "u", f'"a ""{name}""\nof two, lines"', f"x{i}{j}"]) + "\n" for j in range(2)))
        want |= {(f"x{i}{j}", f'a "{name}"\nof two, lines', 0 if i % 2 else 1, f"site{i}") for j in range(2)}
    put(tmp_path / "deep" / "noid_fake", "part.csv", "title,more\nfirst,1\n,2\nthird,\n")
    put(tmp_path, "other.csv", "nothing\nhere\n")
    put(tmp_path, "empty_fake.csv", "")
    put(tmp_path, "heads_real.csv", "title,id\n")
    want |= {("0", "first", 0, "noid"), ("1", None, 0, "noid"), ("2", "third", 0, "noid")}
    assert {tuple(r) for r in S.load_news(spark, str(tmp_path)).collect()} == want


def test_no_text_column(spark, tmp_path):
    put(tmp_path, "site_fake.csv", "id,url\n1,u\n")
    with pytest.raises(Exception, match="could not find a text column in .*site_fake.csv; columns were id, url"):
        S.load_news(spark, str(tmp_path)).collect()


def test_raw_defaults_and_catalog(spark, tmp_path):
    put(tmp_path, "a.csv", "tweet_ids,id\n1\t2,n1\n,n2\n")
    put(tmp_path, "b.csv", "tweet_ids\n7\n8\n")
    put(tmp_path, "c.csv", "url,id,title\nu,n3,t\n")
    put(tmp_path, "d.csv", "id\n")
    got = sorted(tuple(r) for r in S.raw_stack(spark, str(tmp_path)).collect())
    assert got == [("0", "7"), ("1", "8"), ("n1", "1\t2"), ("n2", ""), ("n3", "")]
    assert sorted(tuple(r) for r in S.file_catalog(spark, str(tmp_path)).collect()) == [("a.csv", 2, 2), ("b.csv", 2, 1), ("c.csv", 1, 3)]
    with pytest.raises(Exception, match="more than 2 columns in .*c.csv"):
        S.read_csv_files(spark, str(tmp_path), 2).collect()


def test_many_files_make_one_scan(spark, tmp_path):
    """The plan does not grow with the files, and row numbers start anew in each of those that share a partition."""
    for i in range(300):
        put(tmp_path, f"s{i}_real.csv", f"{'title' if i % 2 else 'body'}\n" + "".join(f"t{i} {j}\n" for j in range(3)))
    news = S.load_news(spark, str(tmp_path))
    assert news._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 2
    assert {tuple(r) for r in news.collect()} == {(str(j), f"t{i} {j}", 1, f"s{i}") for i in range(300) for j in range(3)}
