"""A full refresh with a report of its steps."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.quality import empty_sku_check
from tidemark.plans.dashboard import Inputs
from tidemark.sources.documents import dashboard_document, read_dashboard, write_dashboard
from tidemark.sources.sales import read_inventory
from tidemark.sources.sinks import write_inventory_csv, write_inventory_json

SUCCESS, FAILED, WARNING = "success", "failed", "warning"


def run_steps(steps: list[tuple[str, Callable[[], tuple[bool, str]], str]]) -> list[tuple[str, str, str]]:
    """Run named steps in order; a failing step does not stop the next.

    A step returns (ok, message); its third entry is the status that stands for not ok.
    """
    report = []
    for name, action, bad in steps:
        try:
            ok, message = action()
            report.append((name, SUCCESS if ok else bad, message))
        except Exception as error:  # a step's failure is a row of the report
            report.append((name, FAILED, f"{type(error).__name__}: {error}".splitlines()[0]))
    return report


def overall_status(report: list[tuple[str, str, str]]) -> str:
    statuses = [status for _, status, _ in report]
    if FAILED not in statuses:
        return SUCCESS
    return "partial_success" if SUCCESS in statuses else FAILED


def refresh(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Write inventory (CSV and JSON) and the dashboard below ``out``, then check it.

    Returns one row per step plus the overall row.
    """
    inputs = Inputs(spark, path)

    def inventory_csv():
        write_inventory_csv(inputs.inventory, f"{out}/inventory_csv")
        return True, "inventory written"

    def dashboard():
        write_dashboard(dashboard_document(inputs.plan, inputs.heroes), f"{out}/dashboard")
        return True, "dashboard written"

    def inventory_json():
        write_inventory_json(read_inventory(spark, f"{out}/inventory_csv"), f"{out}/inventory_json")
        return True, "inventory converted"

    def check():
        row = empty_sku_check(read_dashboard(spark, f"{out}/dashboard")).first()
        return row["ok"], f"{row['empty_count']} empty SKUs found"

    report = run_steps([
        ("generate_inventory", inventory_csv, FAILED),
        ("build_dashboard", dashboard, FAILED),
        ("generate_inventory_json", inventory_json, FAILED),
        ("check_empty_skus", check, WARNING),
    ])
    report.append(("overall", overall_status(report), f"{len(report)} steps"))
    return spark.createDataFrame(report, "step string, status string, message string")
