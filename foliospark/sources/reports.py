"""Report sinks: small results, written by the driver."""

from __future__ import annotations

import csv
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame

from foliospark.operators.reconcile import EXTRA
from foliospark.sources.workbook import write_workbook

OVERVIEW = ["项目名称", "文件夹", "应交份数", "实收份数", "状态", "缺失", "多余", "命名不一致"]
DETAIL = ["项目名称", "问题类型", "问题内容"]
TITLE, MADE_AT, ROOT, UNLISTED = "资料完整性核对报告", "生成时间", "核对目录", "目录中存在但进度表未列出："
TOTALS = [
    [("项目数", "projects"), ("应交合计", "required_total"), ("实收合计", "actual_total")],
    [("缺失合计", "missing_total"), ("多余合计", "extra_total"), ("命名不一致合计", "mismatch_total")],
]


def _overview(report: DataFrame) -> list[list]:
    ordered = report.orderBy("ord").toLocalIterator()
    lists = ("missing", "extra", "mismatch")
    return [[r["name"], r["folder"], len(r["required"]), len(r["actual"]), r["status"], *["、".join(r[k]) for k in lists]] for r in ordered]


def _detail(problems: DataFrame, unlisted: DataFrame | None) -> list[list]:
    """One line a problem, then one a folder (folder, files) that no project uses."""
    own = [[r["name"], r["kind"], r["detail"]] for r in problems.orderBy("ord", "k", "pos").toLocalIterator()]
    others = unlisted.orderBy("folder").toLocalIterator() if unlisted is not None else ()
    return own + [[r["folder"], EXTRA, UNLISTED + "、".join(r["files"])] for r in others]


def _head(summary: DataFrame, root: str, made_at: datetime | None) -> list[list]:
    found = summary.first().asDict()
    totals = [[x for label, key in line for x in (label, found[key])] for line in TOTALS]
    return [[TITLE], [MADE_AT, (made_at or datetime.now()).strftime("%Y-%m-%d %H:%M:%S")], [ROOT, root], *totals]


def export_csv(
    report: DataFrame, problems: DataFrame, summary: DataFrame, path: str, root: str = "", unlisted: DataFrame | None = None, made_at: datetime | None = None
) -> str:
    """Title block, overview, long-form problems with unlisted folders; UTF-8 with a byte order mark. The path written."""
    Path(path).absolute().parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerows(_head(summary, root, made_at))
        out.writerows([[], OVERVIEW, *_overview(report), [], DETAIL, *_detail(problems, unlisted)])
    return path


def export_xlsx(
    report: DataFrame, problems: DataFrame, summary: DataFrame, path: str, root: str = "", unlisted: DataFrame | None = None, made_at: datetime | None = None
) -> str:
    """The same as a workbook of two sheets. The path written."""
    head = _head(summary, root, made_at)
    write_workbook(path, {"总览": [*head, [], OVERVIEW, *_overview(report)], "问题": [DETAIL, *_detail(problems, unlisted)]})
    return path


def import_rules(rules: DataFrame, target: str) -> int:
    """Replace the rule table at ``target`` if the new one isn't empty; the old one stays beside it."""
    count = rules.filter("trim(coalesce(pattern, '')) <> ''").count()
    if not count:
        raise ValueError("no rules")
    place, staged, backup = Path(target), Path(f"{target}.new"), Path(f"{target}.bak")
    rules.write.mode("overwrite").parquet(str(staged))
    if backup.exists():
        import shutil

        shutil.rmtree(backup)
    if place.exists():
        place.rename(backup)
    staged.rename(place)
    return count
