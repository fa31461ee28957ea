"""Plan audit: for every registered (non-model) query, count hash/range
exchanges, broadcasts, single-partition exchanges and unpartitioned windows
in the executed physical plan."""
import re, sys
sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.abspath(__file__)))
from loanlens.session import get_spark
from loanlens.plans.registry import queries
spark = get_spark("local[8]")
sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
skip = {"train_logistic","train_forest","train_boosted","model_comparison","calibrate_isotonic",
        "global_importance","local_reasons","shap_sample_importance","score_batch","score_stream","drift_stream"}
for name, fn in queries().items():
    if name in skip:
        continue
    df = fn(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    single = plan.count("SinglePartition")
    bcast = plan.count("BroadcastExchange")
    exch = len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", plan))
    win_nopart = len(re.findall(r"Window \[[^\]]*\], \[\], \[", plan))
    print(f"{name:32s} hashx={exch:2d} bcast={bcast:2d} single={single:2d} window_nopart={win_nopart}")
