"""Vocabularies and thresholds that fix the meaning of the results.

Everything in this module is fixed values: names, word lists, patterns and
constants that must equal the published ontology for the results to be right.
"""

# --- fixed values: calendar -------------------------------------------------
DAYS_PER_YEAR = 365.2425
GREGORIAN_ID = "Q1985727"
JULIAN_ID = "Q1985786"
CUTOFF_AGES = (18, 25, 30, 40)
AS_OF_YEAR = 2026
HAZARD_INTERVALS = ((0, 0, 1), (1, 1, 3), (2, 3, 5), (3, 5, 10), (4, 10, 20))
MAX_UNKNOWN_DEATH_AGE = 100

# --- fixed values: event domains, families and classes ----------------------
DOMAINS = (
    "education", "career", "migration", "creation", "recognition", "organization",
    "relationship", "family", "setback", "finance", "legal", "performance",
)
HIGH_FREQUENCY = ("creation.scholar_output", "creation.music_output", "performance.event")
CLASSES_4 = ("career", "recognition", "relationship", "other")
HAZARD_CLASSES = ("career", "no_event", "other", "recognition", "relationship")
EVENT_CLASSES = ("career", "other", "recognition", "relationship")

# --- fixed values: event family by the first substring that matches ---------
FAMILY_RULES = (
    ("education.complete", ("graduat", "education.complete", "degree.complete")),
    ("education.start", ("education.start", "enroll", "education.affiliation.start")),
    ("education.degree", ("education.degree",)),
    ("education.affiliation", ("education.affiliation",)),
    ("career.role_start", ("career.position.start", "career.employer.start", "career.role_start", "career.appointment")),
    ("career.role_end", ("career.position.end", "career.employer.end", "career.retirement", "career.role_end")),
    ("career.role", ("career.position", "career.employer", "career.occupation", "career.team", "career.military_rank")),
    ("migration.move", ("migration.residence", "migration.cross_region", "emigrat", "immigrat", "relocat")),
    ("creation.scholar_output", ("creation.scholar_work",)),
    ("creation.music_output", ("creation.music_release_group",)),
    ("creation.notable_work", ("creation.notable_work",)),
    ("creation.publication", ("creation.publication", "creation.release")),
    ("creation.founding", ("creation.founded", "creation.organization_founded")),
    ("organization.found", ("organization.found",)),
    ("creation.discovery", ("creation.discovery", "creation.invention")),
    ("recognition.award", ("recognition.award",)),
    ("recognition.election", ("recognition.election",)),
    ("relationship.marriage", ("relationship.marriage", "relationship.spouse.start", "relationship.spouse")),
    ("relationship.divorce", ("relationship.divorce", "relationship.spouse.end")),
    ("family.child_birth", ("family.child_birth",)),
    ("family.parent_loss", ("family.parent_loss",)),
    ("organization.affiliation", ("organization.member", "organization.affiliation", "organization.party")),
    ("performance.event", ("performance.music_event",)),
    ("legal.arrest", ("legal.arrest",)),
    ("legal.imprisonment", ("legal.imprisonment",)),
    ("legal.conviction", ("legal.conviction",)),
    ("legal.acquittal", ("legal.acquittal",)),
    ("setback.legal", ("setback.arrest", "setback.imprisonment")),
    ("setback.financial", ("setback.bankruptcy",)),
    ("setback.job_loss", ("setback.job_loss",)),
)

# --- fixed values: state family of annual states ----------------------------
STATE_FAMILY_RULES = (
    ("creation.scholar_output", ("creation.scholar_work",)),
    ("creation.music_output", ("creation.music_release_group",)),
    ("performance.event", ("performance.music_event",)),
    ("career.role_start", ("career.position.start", "career.employer.start", "career.role_start", "career.appointment")),
    ("career.role_end", ("career.position.end", "career.employer.end", "career.retirement")),
    ("education.start", ("education.affiliation.start", "education.start")),
    ("education.end", ("education.affiliation.end", "education.complete")),
    ("relationship.start", ("relationship.spouse.start", "relationship.marriage")),
    ("relationship.end", ("relationship.spouse.end", "relationship.divorce")),
    ("migration.move", ("migration",)),
    ("recognition.event", ("recognition",)),
)

# --- fixed values: coverage tiers (points, domains, stages, sources) --------
TIERS = (("gold", 25, 5, 4, 2), ("silver", 15, 4, 3, 2), ("bronze", 8, 3, 2, 1))
STAGES = ((0, 18, "0-17"), (18, 25, "18-24"), (25, 35, "25-34"), (35, 50, "35-49"), (50, 65, "50-64"), (65, 200, "65+"))

# --- fixed values: birth eras and edition tiers -----------------------------
ERAS = (
    (1800, 1849, "1800-1849"), (1850, 1899, "1850-1899"), (1900, 1924, "1900-1924"),
    (1925, 1949, "1925-1949"), (1950, 1969, "1950-1969"), (1970, 1989, "1970-1989"),
    (1990, 2005, "1990-2005"),
)
EDITION_TIERS = ((1, "wiki1"), (3, "wiki2-3"), (10, "wiki4-10"))

# --- fixed values: confidence by source -------------------------------------
EXTERNAL_CONFIDENCE = {"openalex": 0.92, "musicbrainz": 0.90}
EXTERNAL_CONFIDENCE_DEFAULT = 0.75
NOTABLE_WORK_CONFIDENCE = 0.64
RULE_EVENT_CONFIDENCE = 0.82

# --- fixed values: future targets -------------------------------------------
TARGETS = (
    ("migration_cross_country", ("migration.cross_country",)),
    ("career_domain_change", ("career.domain_change",)),
    ("first_major_creation", ("creation.first_major_work", "creation.publication", "creation.product_launch", "creation.research_breakthrough")),
    ("public_recognition", ("recognition.award", "recognition.public_breakthrough", "recognition.appointment", "recognition.election")),
    ("organization_building", ("organization.found", "organization.lead")),
    ("entrepreneurship", ("finance.business_founded", "creation.product_launch")),
    ("long_term_partnership_transition", ("relationship.long_term_start", "relationship.marriage", "relationship.separation", "relationship.divorce")),
)
TARGET_HORIZONS = (5, 10)

# --- fixed values: text markers ---------------------------------------------
YEAR_PATTERN = r"\b(?:1[0-9]{3}|20\d{2})\b"
AGE_EN_PATTERN = r"\b(?:aged?|age)\s+(\d{1,2})\b"
AGE_ZH_PATTERN = r"(\d{1,2})\s*岁"
SENTENCE_PATTERN = r"(?<=[.!?。！？])\s+|\n+"
CLIP_LIMIT, CLIP_BEFORE, CLIP_AFTER = 700, 250, 450

# --- fixed values: keyword patterns per domain ------------------------------
KEYWORDS = {
    "education": ("universit", "college", "school", "graduat", "enroll", "studied", "degree", "学院", "大学", "毕业", "入学", "就读"),
    "career": ("appointed", "joined", "worked", "career", "became", "promot", "retir", "resign", "任职", "加入", "工作", "升任", "辞职", "退休"),
    "migration": ("moved", "emigrat", "immigrat", "relocat", "returned to", "exil", "移居", "迁往", "搬到", "回到", "流亡"),
    "creation": ("publish", "released", "wrote", "directed", "launched", "invent", "discover", "作品", "出版", "发表", "推出", "发明", "发现"),
    "organization": ("founded", "co-founded", "established (?:a|the) (?:company|foundation|organization|party|institute)", "创立", "创办", "成立.*(?:公司|基金会|组织|政党|研究所)"),
    "recognition": ("award", "won", "prize", "honou?r", "elected", "nominat", "获奖", "获得", "当选", "提名"),
    "relationship": ("married", "divorc", "separat", "婚", "离婚", "分居"),
    "family": ("(?:son|daughter|child) was born", "gave birth to", "had (?:a|their) (?:son|daughter|child)", "(?:mother|father) died", "(?:母亲|父亲|母親|父親).*去世", "儿子.*出生", "女儿.*出生", "兒子.*出生", "女兒.*出生"),
    "legal": ("arrested", "imprison", "convicted", "acquitted", "逮捕", "监禁", "監禁", "定罪", "无罪", "無罪"),
    "setback": ("fired", "dismissed", "bankrupt", "defeat", "failed", "破产", "失败", "被解雇"),
}

# --- fixed values: trigger patterns of typed rule events, first match wins --
TRIGGERS = (
    ("education.complete", ("graduat", "毕业")),
    ("education.start", ("enroll", "entered .*univers", "began .*univers", "入学", "就读")),
    ("career.retirement", ("retir", "退休")),
    ("career.appointment", ("appoint", "became .*professor", "became .*director", "任命", "升任")),
    ("career.role_start", ("joined", "began work", "started work", "任职", "加入")),
    ("migration.cross_region", ("emigrat", "immigrat", "moved to", "relocat", "移居", "迁往", "搬到")),
    ("creation.publication", ("publish", "出版", "发表")),
    ("creation.release", ("released", "发行", "推出")),
    ("organization.found", ("founded", "co-founded", "established (?:a|the) (?:company|foundation|organization|party|institute)", "创立", "创办", "成立.*(?:公司|基金会|组织|政党|研究所)")),
    ("creation.invention", ("invent", "发明")),
    ("creation.discovery", ("discover", "发现")),
    ("recognition.award", ("won .*award", "received .*award", "awarded", "prize", "获奖", "获得.*奖")),
    ("recognition.election", ("elected", "当选")),
    ("relationship.marriage", ("married", "结婚", "成婚")),
    ("relationship.divorce", ("divorc", "离婚")),
    ("family.child_birth", ("(?:son|daughter|child) was born", "gave birth to", "had (?:a|their) (?:son|daughter|child)", "儿子.*出生", "女儿.*出生", "兒子.*出生", "女兒.*出生")),
    ("family.parent_loss", ("(?:mother|father) died", "(?:母亲|父亲|母親|父親).*去世")),
    ("legal.arrest", ("arrest", "逮捕")),
    ("legal.imprisonment", ("imprison", "监禁", "監禁")),
    ("legal.conviction", ("convicted", "定罪")),
    ("legal.acquittal", ("acquitted", "无罪", "無罪")),
    ("setback.bankruptcy", ("bankrupt", "破产")),
    ("setback.job_loss", ("fired", "dismissed", "被解雇")),
)

# --- fixed values: section titles that end the narrative --------------------
TAIL_SECTIONS = (
    "references", "reference", "notes", "sources", "bibliography", "further reading",
    "external links", "works cited", "citations", "see also",
    "参考文献", "參考文獻", "注释", "註釋", "资料来源", "資料來源", "外部链接", "外部連結",
)

# --- fixed values: trait score card -----------------------------------------
TRAITS = ("exploration", "execution", "structure", "stability", "expression")
PAST_EVENT_DELTAS = {
    # domain: (early-scaled exploration, {trait: delta})
    "migration": {"exploration": 0.22, "stability": -0.08},
    "education": {"exploration": 0.13, "structure": 0.07},
    "career": {"exploration": 0.15, "execution": 0.08},
    "relationship": {"stability": 0.04, "expression": 0.05},
    "family": {"stability": 0.10, "structure": 0.05},
    "recognition": {"expression": 0.16, "execution": 0.14},
    "project": {"execution": 0.18, "structure": 0.10},
    "setback": {"stability": -0.08, "exploration": 0.05},
}
EARLY_AGE, EARLY_FACTOR = 22, 1.15
ANSWER_DELTAS = {
    ("under_pressure", "research"): {"exploration": 0.65, "execution": -0.25},
    ("under_pressure", "act"): {"execution": 0.70, "exploration": -0.10},
    ("under_pressure", "avoid"): {"execution": -0.65, "stability": -0.10},
    ("under_pressure", "ask"): {"expression": 0.30, "stability": 0.15},
    ("project_mode", "system"): {"exploration": 0.40, "structure": 0.25, "execution": -0.15},
    ("project_mode", "prototype"): {"execution": 0.50, "expression": 0.15},
    ("project_mode", "switch"): {"exploration": 0.30, "stability": -0.35},
    ("project_mode", "steady"): {"stability": 0.45, "structure": 0.20},
    ("biggest_fear", "direction"): {"exploration": 0.22},
    ("biggest_fear", "money"): {"stability": 0.20},
    ("biggest_fear", "status"): {"expression": 0.18},
    ("biggest_fear", "relationship"): {"stability": 0.12},
    ("biggest_fear", "wasted"): {"execution": 0.10, "exploration": 0.10},
}
SCALE_DELTAS = {"consistency": {"execution": 0.18}, "mobility": {"exploration": 0.12, "stability": -0.10}}
BRANCHES = {
    # branch: (constant, {trait: weight}); a negative trait weight is on 1 - trait
    "drift": (0.30 + 0.20, {"exploration": 0.75, "stability": -0.20}),
    "builder": (0.25, {"structure": 0.50, "execution": 0.45, "exploration": 0.20}),
    "specialist": (0.22, {"stability": 0.70, "structure": 0.35}),
    "creator": (0.18, {"expression": 0.75, "exploration": 0.30}),
}

# --- fixed values: cyclic symbols -------------------------------------------
ELEMENTS = "木火土金水"
STEMS = "甲乙丙丁戊己庚辛壬癸"
BRANCH_SYMBOLS = "子丑寅卯辰巳午未申酉戌亥"
STEM_ELEMENTS = "木木火火土土金金水水"
BRANCH_ELEMENTS = "水土木木土火火土金金土水"
BRANCH_HIDDEN_STEMS = ("癸", "己癸辛", "甲丙戊", "乙", "戊乙癸", "丙庚戊", "丁己", "己丁乙", "庚壬戊", "辛", "戊辛丁", "壬甲")
TEN_ROLES = ("比肩", "劫财", "食神", "伤官", "偏财", "正财", "七杀", "正官", "偏印", "正印")
BRANCH_PAIRS = {
    "zhi_liuhe": ("子丑", "寅亥", "卯戌", "辰酉", "巳申", "午未"),
    "zhi_chong": ("子午", "丑未", "寅申", "卯酉", "辰戌", "巳亥"),
    "zhi_hai": ("子未", "丑午", "寅巳", "卯辰", "申亥", "酉戌"),
    "zhi_po": ("子酉", "丑辰", "寅亥", "卯午", "巳申", "未戌"),
    "zhi_xing": ("子卯", "寅巳", "巳申", "寅申", "丑戌", "戌未", "丑未"),
    "zhi_self_xing": ("辰辰", "午午", "酉酉", "亥亥"),
}
STEM_PAIRS = {
    "gan_he": ("甲己", "乙庚", "丙辛", "丁壬", "戊癸"),
    "gan_chong": ("甲庚", "乙辛", "丙壬", "丁癸"),
}
BRANCH_TRIADS = {
    "sanhe_complete": ("申子辰", "亥卯未", "寅午戌", "巳酉丑"),
    "sanhui_complete": ("寅卯辰", "巳午未", "申酉戌", "亥子丑"),
}
