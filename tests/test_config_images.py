import numpy as np
import pytest

from pagelattice import config
from pagelattice.operators import raster
from pagelattice.sources import files, images


def test_pairs_and_files(tmp_path):
    (tmp_path / "args").write_text("--p a=1 b=0.5  # comment\n--p c=[x,true] d=word\n")
    parser = config.LineParser()
    parser.add_argument("--p", nargs="+", action=config.Pairs, default={})
    got = parser.parse_args([f"@{tmp_path / 'args'}"]).p
    assert got == {"a": 1, "b": 0.5, "c": ["x", True], "d": "word"}
    assert config.overridden({"a": 0, "z": 2}, got) == {"a": 1, "z": 2}
    assert config.truth("T") and not config.truth("0")
    with pytest.raises(ValueError):
        config.truth("maybe")


def test_images(spark, tmp_path):
    image = np.full((20, 30), 220, np.uint8)
    image[5:10, 5:20] = 10
    (tmp_path / "a.pgm").write_bytes(images.encode_pgm(image))
    (tmp_path / "b.pgm").write_bytes(b"P2\n# x\n2 1\n255\n0 255\n")
    got = {r.path[-5:]: r for r in images.measured(spark, str(tmp_path), lambda x: (int(raster.binarize(x).sum()),), "ink int").collect()}
    assert (got["a.pgm"].width, got["a.pgm"].height, got["a.pgm"].ink) == (30, 20, 75)
    assert got["b.pgm"].ink == 1
    half = images.resize(image, 0.5)
    assert half.shape == (10, 15) and half[3, 4] == 10 and images.resize(image, 2).shape == (40, 60)
    assert images.scale_for(4000, 1000, 2000) == 0.5 and images.scale_for(10, 10, 20) == 1.0
    wanted = spark.createDataFrame([(str(tmp_path / "a.pgm"),), (str(tmp_path / "c.pgm"),)], "path string")
    assert [r.path[-5:] for r in files.missing_files(spark, wanted, str(tmp_path)).collect()] == ["c.pgm"]


def test_region_json(spark):
    df = spark.sql("select 'i' as image, 10 as width, 20 as height, id as pos, 'text' as class_name, array(struct(0 as x, 0 as y), struct(1 as x, 2 as y)) as points from range(2)")
    text = files.region_json(df).first().json
    assert '"x_points":[0,1,0]' in text and '"0":' in text and '"height":20' in text
    with pytest.raises(Exception, match="[Dd]uplicate"):
        files.region_json(df.union(df)).collect()
