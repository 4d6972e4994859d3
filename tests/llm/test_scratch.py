import os
from types import SimpleNamespace

import pytest

from mereling.llm import exact_dedup, pii, scratch, url_filter


@pytest.mark.parametrize("master", ["spark://a:7077", "yarn", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.folder(session)


def test_temporary_tables_go_and_others_stay(spark):
    with scratch.temporary():
        gone = scratch.keep(spark.range(3), "gone")
        stays = scratch.keep(gone, "stays", stays=True)
        paths = [df.inputFiles()[0].removeprefix("file://") for df in (gone, stays)]
        assert all(map(os.path.exists, paths))
    assert [os.path.exists(p) for p in paths] == [False, True] and stays.count() == 3


def test_native_operators_have_no_python_in_their_plans(spark, edge):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    labels = spark.createDataFrame([(1, True)], "page_id long, bad boolean")
    for df in (exact_dedup.exact_groups(edge), exact_dedup.drop_copies(edge), pii.find_pii(edge), pii.redact(edge), url_filter.judge(pages, labels, [("allow", "org", "/")])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExternalRDD"))
