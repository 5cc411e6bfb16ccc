"""Parser configuration: an immutable value made on the driver and captured by plans."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path

VERSION = 1

# The engine's default vocabulary of power-utility paperwork.
SUFFIXES = (
    "业扩配套工程", "低压台区维修项目", "低压维修项目", "低压维护项目", "台区维修项目", "线路维修项目",
    "维修项目", "配套工程", "业扩工程", "改造项目", "新建工程", "项目",
)
NOISE = (
    "建设单位", "施工单位", "监理单位", "设计单位", "项目负责人", "施工负责人", "填报人", "计划开工",
    "计划竣工", "开工时间", "竣工时间", "工程地点", "工程编号", "线路名称", "工程量", "项目名称",
)
FIXES = {
    "业扩配食工程": "业扩配套工程",
    "业扩配门工程": "业扩配套工程",
    "业扩配套工稈": "业扩配套工程",
    "低压台区维休项目": "低压台区维修项目",
    "低压维休项目": "低压维修项目",
    "峻工报告": "竣工报告",
    "峻工": "竣工",
    "合区": "台区",
}
FEATURE_STRIPS = (
    r"20\d{2}年?",
    r"[省市区县镇乡村]",
    r"第[一二三四五六七八九十百]+批",
    r"低压|高压|中压",
    r"(?:台区|线路)?(?:维修|维护|改造|新建|配套)?(?:项目|工程)",
    r"包\d+",
    r"\d{10,}",
)
DESIGN_UNIT = (
    r"[一-龥]{2,20}(?:电力勘察设计|勘察设计|电力设计|设计|勘测)(?:院|有限公司|有限责任公司|公司|分公司)?"
)
ORGANISATION = (
    r"[一-龥]{2,20}(?:工程安装|安装工程|建设|建工|施工|监理)(?:有限公司|有限责任公司|公司|分公司)"
)
NAME_LABEL = r"工程(?:名称|名栋|名[厦回因]?|标[名]?)"
CODE_LABEL = r"工程编号[:：号]?\d{9,}|\d{11,}\s*$|工程编号"


@dataclass(frozen=True)
class Config:
    region_words: tuple[str, ...] = ()
    region_fuzzy_tolerance: int | str = 1
    region_fuzzy_max_tolerance: int = 1
    region_fuzzy_min_len: int = 2
    region_fuzzy_require_suffix_char: bool = True
    business_suffixes: tuple[str, ...] = SUFFIXES
    noise_words: tuple[str, ...] = NOISE
    valid_keywords: tuple[str, ...] = ()
    min_name_len: int = 8
    max_name_len: int = 60
    max_digit_run: int = 4
    name_charset: str = r"一-龥A-Za-z0-9#*※（）()\-\.·"
    symbol_fixes: dict[str, str] = field(default_factory=lambda: {"*": "#", "※": "#"})
    ocr_fixes: dict[str, str] = field(default_factory=lambda: dict(FIXES))
    region_ocr_fixes: dict[str, str] = field(default_factory=dict)
    folder_score_threshold: float = 0.55
    feature_strip_patterns: tuple[str, ...] = FEATURE_STRIPS
    design_unit_pattern: str = DESIGN_UNIT
    org_noise_pattern: str = ORGANISATION
    feature_min_len: int = 3
    feature_score_threshold: float = 0.62
    code_match_enabled: bool = True
    code_match_bonus: float = 0.35
    code_mismatch_penalty: float = 0.75
    code_fuzzy_tolerance: int = 2
    name_label_pattern: str = NAME_LABEL
    code_label_pattern: str = CODE_LABEL

    @property
    def fixes(self) -> list[tuple[str, str]]:
        """Corrections in the order they apply: longest wrong form first; general ones win over regional ones."""
        merged = {**self.region_ocr_fixes, **self.ocr_fixes}
        return sorted(((k, v) for k, v in merged.items() if k), key=lambda kv: (-len(kv[0]), kv[0]))

    @property
    def suffixes(self) -> list[str]:
        """Business suffixes with their loose forms, longest first."""
        base = [s for s in self.business_suffixes if s]
        cut = [s[:-2] for s in base if s.endswith(("工程", "项目")) and len(s) > 4]
        both = base + cut
        volts = [v + s for s in both if s.startswith(("业扩", "配套")) and "kV" not in s for v in ("10kV", "0.4kV")]
        return sorted({*both, *volts}, key=lambda s: (-len(s), s))

    @property
    def regions(self) -> list[str]:
        return sorted((w for w in self.region_words if w), key=lambda w: (-len(w), w))

    def tolerance(self, word: str) -> int:
        """Characters of a region word that may differ."""
        raw = self.region_fuzzy_tolerance
        if isinstance(raw, str):
            raw = len(word) // 3 if raw.strip().lower() == "auto" else int(raw) if raw.strip().isdigit() else 0
        return max(0, min(int(raw or 0), self.region_fuzzy_max_tolerance, len(word) - 1))

    def with_(self, **changes) -> Config:
        return dataclasses.replace(self, **changes)


def merged(overrides: dict) -> Config:
    """Defaults with overrides: null values and keys that begin with ``_`` are skipped, lists are replaced."""
    names = {f.name for f in dataclasses.fields(Config)}
    known = {k: v for k, v in overrides.items() if k in names and v is not None and not k.startswith("_")}
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in known.items()})


def load(path: str) -> tuple[Config, str | None]:
    """The configuration at ``path`` and what was wrong with it; defaults if it is absent or unreadable."""
    file = Path(path)
    if not file.exists():
        return Config(), None
    try:
        return merged(json.loads(file.read_text("utf-8"))), None
    except (ValueError, TypeError, AttributeError) as error:
        return Config(), str(error)


def save(config: Config, path: str) -> None:
    """Write only what differs from the defaults."""
    plain = dataclasses.asdict(Config())
    changed = {k: v for k, v in dataclasses.asdict(config).items() if v != plain[k]}
    Path(path).write_text(json.dumps({"version": VERSION, **changed}, ensure_ascii=False, indent=2), "utf-8")
