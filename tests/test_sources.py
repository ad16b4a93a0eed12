"""Loaders on small files in the layouts of the public datasets."""

import datetime as dt
import gzip
import zipfile

import pytest

from recmill.errors import DataError
from recmill.sources.frames import flatten, from_interactions, load_config, unflatten
from recmill.sources.movielens import load_movielens, load_ratings
from recmill.sources.others import load_amazon, load_msweb, load_steam, load_steam_all, pyon_loads


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture
def latest(tmp_path):
    d = tmp_path / "ml-tiny"
    d.mkdir()
    (d / "ratings.csv").write_text("userId,movieId,rating,timestamp\n1,10,4.0,964982703\n1,20,3.5,964981247\n2,10,5.0,964982224\n")
    (d / "movies.csv").write_text('movieId,title,genres\n10,"Story, A (1995)",Adventure|Comedy\n20,"Say ""Hi"" (1996)",(no genres listed)\n30,Unseen (1999),Drama\n')
    (d / "tags.csv").write_text("userId,movieId,tag,timestamp\n1,10,Funny,1\n2,10,funny,2\n2,10,old,3\n1,30,old,4\n")
    (d / "genome-tags.csv").write_text("tagId,tag\n1,dark\n2,light\n")
    (d / "genome-scores.csv").write_text("movieId,tagId,relevance\n10,1,0.25\n10,2,0.5\n20,2,1.0\n99,1,0.1\n")
    return d


def _check_latest(ds):
    assert _rows(ds.interactions().log, "user_id", "item_id", "rating") == [(1, 10, 4.0), (1, 20, 3.5), (2, 10, 5.0)]
    items = {r["item_id"]: r for r in ds.entity_tables["item"].collect()}
    assert items[10]["title"] == "Story, A (1995)" and items[10]["genres"] == ["Adventure", "Comedy"] and items[20]["genres"] is None and items[20]["title"] == 'Say "Hi" (1996)'
    assert ds.schema.entities["item"].attributes["tag_counts"].names == ["funny", "old"]
    assert [(x["index"], x["value"]) for x in items[10]["tag_counts"]] == [(0, 2.0), (1, 1.0)] and items[20]["tag_counts"] is None
    assert items[10]["genome"] == [0.25, 0.5] and items[20]["genome"] == [0.0, 1.0] and items[30]["genome"] is None


def test_movielens_csv(spark, latest):
    ds = load_movielens(spark, str(latest))
    _check_latest(ds)
    assert ds.name == "ml-tiny"
    assert load_ratings(spark, str(latest)).where("user_id = 2").first()["timestamp"] == dt.datetime(2000, 7, 30, 18, 37, 4)


def test_movielens_zip(spark, latest, tmp_path):
    with zipfile.ZipFile(tmp_path / "ml.zip", "w") as z:
        for f in latest.iterdir():
            z.write(f, f"ml-tiny/{f.name}")
    _check_latest(load_movielens(spark, str(tmp_path / "ml.zip")))


def test_movielens_100k(spark, tmp_path):
    (tmp_path / "u.data").write_text("1\t10\t3\t881250949\n2\t10\t4\t891717742\n")
    (tmp_path / "u.item").write_bytes("10|Café (1995)|01-Jan-1995||url|0|1\n11|Other|||u|1|0\n".encode("latin-1"))
    (tmp_path / "u.user").write_text("1|24|M|technician|85711\n2|53|F|other|94043\n3|23|M|writer|32067\n")
    ds = load_movielens(spark, str(tmp_path))
    assert _rows(ds.interactions().log, "user_id", "item_id", "rating") == [(1, 10, 3.0), (2, 10, 4.0)]
    assert {r["item_id"]: r["title"] for r in ds.entity_tables["item"].collect()} == {10: "Café (1995)", 11: "Other"}
    assert {r["user_id"]: (r["age"], r["zip_code"]) for r in ds.entity_tables["user"].collect()}[3] == (23, "32067")


def test_movielens_dat(spark, tmp_path):
    (tmp_path / "ratings.dat").write_text("1::122::5::838985046\n2::185::2.5::838983525\n")
    (tmp_path / "movies.dat").write_text("122::Boomerang: A Film (1992)::Comedy|Romance\n185::Net, The (1995)::Action\n")
    (tmp_path / "tags.dat").write_text("15::122::has :: in it::1215184630\n")
    ds = load_movielens(spark, str(tmp_path))
    assert _rows(ds.interactions().log, "user_id", "item_id", "rating") == [(1, 122, 5.0), (2, 185, 2.5)]
    items = {r["item_id"]: r for r in ds.entity_tables["item"].collect()}
    assert items[122]["title"] == "Boomerang: A Film (1992)" and items[122]["genres"] == ["Comedy", "Romance"]
    assert ds.schema.entities["item"].attributes["tag_counts"].names == ["has :: in it"]
    with pytest.raises(FileNotFoundError):
        load_movielens(spark, str(tmp_path / "none"))


def test_amazon(spark, tmp_path):
    (tmp_path / "ratings_Toys.csv").write_text("A1YJEY40YUW4SE,7806397051,3.0,1391040000\n")
    (tmp_path / "Toys.csv").write_text("B000FA5KKA,A1D4SDNYWXB1Y,5.0,1433116800\n")
    with gzip.open(tmp_path / "Toys23.csv.gz", "wt") as f:
        f.write("user_id,parent_asin,rating,timestamp\nAEVWAM3YWN5URJ,B00XBZFWWM,4.0,1427220000123\n")
    got = {}
    for name in ("ratings_Toys.csv", "Toys.csv", "Toys23.csv.gz"):
        got[name] = _rows(load_amazon(spark, str(tmp_path / name)).interactions().log, "user_id", "item_id", "rating", "timestamp")
    assert got["ratings_Toys.csv"] == [("A1YJEY40YUW4SE", "7806397051", 3.0, dt.datetime(2014, 1, 30))]
    assert got["Toys.csv"] == [("A1D4SDNYWXB1Y", "B000FA5KKA", 5.0, dt.datetime(2015, 6, 1))]
    assert got["Toys23.csv.gz"] == [("AEVWAM3YWN5URJ", "B00XBZFWWM", 4.0, dt.datetime(2015, 3, 24, 18, 0, 0, 123000))]
    both = load_amazon(spark, str(tmp_path / "ratings_Toys.csv"), str(tmp_path / "Toys.csv"))
    assert both.interactions().count() == 2
    with pytest.raises(ValueError):
        load_amazon(spark)


def test_msweb(spark, tmp_path):
    lines = ['I,4,"www"', 'A,1287,1,"Autoroute","/autoroute"', 'A,1288,1,"library","/library"', 'C,"10001",10001', "V,1287,1", "V,1288,1", 'C,"10002",10002', 'C,"10003",10003', "V,1288,1"]
    with gzip.open(tmp_path / "web.data.gz", "wt") as f:
        f.write("\n".join(lines) + "\n")
    ds = load_msweb(spark, str(tmp_path / "web.data.gz"))
    assert _rows(ds.interactions().log, "session_id", "item_id") == [(10001, 1287), (10001, 1288), (10003, 1288)]
    assert {r["item_id"]: (r["title"], r["url"]) for r in ds.entity_tables["item"].collect()} == {1287: ("Autoroute", "/autoroute"), 1288: ("library", "/library")}
    assert load_msweb(spark, str(tmp_path / "web.data.gz"), "lists").total_items() == 3


def test_steam(spark, tmp_path):
    rows = [
        {"user_id": "ann", "items_count": 2, "steam_id": "76561197970982479", "user_url": "u", "items": [{"item_id": "10", "item_name": "Zed's", "playtime_2weeks": 0, "playtime_forever": 6}, {"item_id": "20", "item_name": "Two", "playtime_2weeks": 0, "playtime_forever": 0}]},
        {"user_id": "ann again", "items_count": 1, "steam_id": "76561197970982479", "user_url": "u", "items": [{"item_id": "30", "item_name": "No", "playtime_2weeks": 0, "playtime_forever": 1}]},
        {"user_id": "bob", "items_count": 1, "steam_id": "2", "user_url": "u", "items": [{"item_id": "10", "item_name": "Another name", "playtime_2weeks": 1, "playtime_forever": 2}, {"item_id": "10", "item_name": "Zed", "playtime_2weeks": 1, "playtime_forever": 9}]},
        {"user_id": "eve", "items_count": 0, "steam_id": "3", "user_url": "u", "items": []},
    ]
    with gzip.open(tmp_path / "s.json.gz", "wt") as f:
        f.write("\n".join(map(repr, rows)) + "\n")
    ds = load_steam(spark, str(tmp_path / "s.json.gz"))
    assert _rows(ds.interactions().log, "user_id", "item_id", "playtime_forever") == [(2, 10, 2.0), (76561197970982479, 10, 6.0), (76561197970982479, 20, 0.0)]
    assert {r["item_id"]: r["name"] for r in ds.entity_tables["item"].collect()} == {10: "Zed's", 20: "Two"}
    assert {r["handle"] for r in ds.entity_tables["user"].collect()} == {"ann", "bob", "eve"}
    (tmp_path / "bad.json").write_text(repr(rows[0]) + "\n{broken\n")
    with pytest.raises(Exception, match="no Python literal"):
        load_steam(spark, str(tmp_path / "bad.json"))
    assert load_steam(spark, str(tmp_path / "bad.json"), errors="null").interactions().count() == 2
    assert pyon_loads(" {'a': True} ") == {"a": True} and issubclass(DataError, ValueError)
    with pytest.raises(NotImplementedError):
        load_steam_all("games", "reviews")


def test_frames_and_configs(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3.0, 4)], "userId int, movieId int, Rating double, time long")
    ds = from_interactions(df)
    assert ds.interactions().log.columns[:4] == ["user_id", "item_id", "rating", "timestamp"]
    nested = {"a": 1, "b": {"c": 2, "d": {"e": 3}}, "f": {}}
    assert flatten(nested) == {"a": 1, "b.c": 2, "b.d.e": 3} and unflatten(flatten(nested)) == {"a": 1, "b": {"c": 2, "d": {"e": 3}}}
    (tmp_path / "c.toml").write_text("[x]\ny = 1\n")
    assert load_config(str(tmp_path / "c.toml")) == {"x": {"y": 1}}
    with pytest.raises(ValueError):
        load_config(str(tmp_path / "c.ini")) if (tmp_path / "c.ini").write_text("") == 0 else None
