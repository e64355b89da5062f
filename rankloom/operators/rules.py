"""Rule stages: as-of validity, penalty cleanup, the enforcement gate, guards and coverage rescue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import collapse, law_of

# --- fixed values: classes, patterns and roles of the rule stages ------------------------------

INVALID_CLASSES = ("expired_before_as_of", "not_yet_effective_as_of", "expired_full_unknown_date")
PENALTY_ARTICLE = r"xử phạt|vi phạm hành chính|mức phạt|phạt tiền|biện pháp khắc phục hậu quả|thẩm quyền xử phạt|hình thức xử phạt"
PENALTY_QUESTION = r"xử phạt|mức phạt|phạt|vi phạm|xử lý vi phạm|bị xử lý|xử lý như thế nào|hình thức xử lý|rủi ro pháp lý|hậu quả pháp lý|khắc phục hậu quả|chế tài|trách nhiệm pháp lý|sai phạm|cưỡng chế"
OTHER_QUESTION = r"điều kiện|thủ tục|hồ sơ|thời hạn|bao lâu|cơ quan nào|nộp ở đâu|nộp tại đâu|được hưởng|ưu đãi|quyền|nghĩa vụ|cách tính|xác định|cần chuẩn bị|đăng ký|kê khai|khai thuế|sử dụng loại|áp dụng|có được|phải thực hiện|thành phần|bao gồm|cần có"
PENALTY_LAW = r"xử phạt vi phạm hành chính"
OFFENCE_TITLE = r"^(hành vi )?vi phạm\b|^xử phạt hành vi|xử phạt đối với|phạt tiền đối với"
COERCION_TITLE = r"^(?:các )?(?:trường hợp bị |đối tượng áp dụng )?cưỡng chế\b|^biện pháp cưỡng chế\b|^trình tự.{0,50}cưỡng chế\b|^thi hành quyết định.{0,80}cưỡng chế\b|giao dịch điện tử trong công tác quản lý nợ và cưỡng chế nợ thuế"
OPERATIVE = r"phạt cảnh cáo|phạt tiền|bị xử phạt|mức phạt|hình thức xử phạt"
EXPLICIT_QUESTION = r"xử phạt|bị phạt|mức phạt|phạt tiền|tiền phạt|hình thức xử phạt|chế tài|vi phạm hành chính|biện pháp khắc phục hậu quả"
IMPLICIT_QUESTION = r"bị xử lý(?: như thế nào| ra sao)?|xử lý (?:như thế nào|ra sao)|phải khắc phục|khắc phục hậu quả|rủi ro (?:pháp lý|bị xử phạt)|hậu quả pháp lý|trách nhiệm pháp lý|khắc phục sai phạm|xử lý vi phạm"
VIOLATION_QUESTION = r"có (?:bị coi là )?vi phạm|hành vi (?:này )?vi phạm|vi phạm (?:pháp luật|quy định|luật)|trái (?:pháp luật|quy định)|bị nghiêm cấm|(?:được )?xác định là vi phạm"
COERCION_QUESTION = r"cưỡng chế|nợ thuế|thu hồi nợ|kê biên|phong tỏa tài khoản|trích tiền từ tài khoản|thu tiền từ (?:đối tác|bên thứ ba)|ngừng sử dụng hóa đơn|dừng làm thủ tục hải quan|thu hồi giấy chứng nhận đăng ký doanh nghiệp do nợ thuế|chưa nộp (?:đủ )?(?:số )?thuế|không thể nộp thuế"
ROLE_EXEMPT = r"đối với (?:các )?hành vi|vi phạm (?:quy định )?về"
#: (role, pattern of the title, pattern of a question that asks for it), in order.
ROLES = (
    ("penalty_form", r"^(?:các )?hình thức xử phạt|hình thức xử phạt bổ sung", r"hình thức xử phạt|bị xử phạt bằng hình thức|chế tài (?:nào|gì)"),
    ("penalty_level", r"^(?:(?:quy định về )?mức phạt tiền|mức xử phạt|mức phạt vi phạm hành chính|xác định mức tiền phạt)", r"mức phạt|phạt bao nhiêu|số tiền phạt|mức tiền phạt"),
    ("penalty_authority", r"^thẩm quyền (?:lập biên bản|xử phạt)|phân định thẩm quyền xử phạt", r"ai|cơ quan nào|người nào|thẩm quyền.{0,30}(?:xử phạt|lập biên bản)|phạt tiền tối đa|được phạt tối đa|(?:có )?quyền xử phạt"),
    ("penalty_limitation", r"^thời hiệu xử phạt|thời hạn được coi là chưa bị xử lý", r"thời hiệu xử phạt|thời hạn xử phạt|bao lâu.{0,30}xử phạt"),
    ("penalty_principle", r"^nguyên tắc xử phạt|nguyên tắc áp dụng hình thức xử phạt", r"nguyên tắc.{0,30}xử phạt"),
    ("penalty_subject", r"^đối tượng (?:bị xử phạt|xử phạt|áp dụng xử phạt|áp dụng cưỡng chế)", r"ai|đối tượng nào|chủ thể nào|người nào.{0,30}(?:bị )?xử phạt"),
    ("penalty_circumstance", r"^tình tiết (?:giảm nhẹ|tăng nặng)|tình tiết giảm nhẹ, tình tiết tăng nặng", r"tình tiết (?:giảm nhẹ|tăng nặng)|quy mô lớn"),
    ("remedy", r"^biện pháp khắc phục hậu quả", r"biện pháp khắc phục hậu quả|phải khắc phục|khắc phục (?:hậu quả )?(?:ra sao|thế nào|như thế nào)"),
)

# --- expressions ------------------------------------------------------------------------------


def has(c: Column, pattern: str) -> Column:
    """Whether the pattern occurs, whatever the case of any letter."""
    return F.coalesce(F.rlike(c, F.lit("(?iuU)" + pattern)), F.lit(False))


def first_of(cases: list[tuple[Column, Column | str | None]], otherwise=None) -> Column:
    """The value of the first case that holds."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return reduce(lambda rest, case: F.when(case[0], lit(case[1])).otherwise(rest), reversed(cases), lit(otherwise))


def penalty_decision(question: Column, law_name: Column, title: Column) -> Column:
    """drop and reason: a penalty article goes if the question asks for something else and not for penalties."""
    q = collapse(question)
    reason = first_of(
        [
            (~has(F.concat_ws(" ", collapse(law_name), collapse(title)), PENALTY_ARTICLE), ""),
            (has(q, PENALTY_QUESTION), "question_penalty_signal"),
            (has(q, OTHER_QUESTION), "non_penalty_question_with_penalty_article"),
        ],
        "ambiguous_question",
    )
    return F.struct((reason == "non_penalty_question_with_penalty_article").alias("drop"), reason.alias("reason"))


def role_of(title: Column) -> Column:
    t = collapse(title)
    return first_of([(has(t, ROLE_EXEMPT), None), *((has(t, pattern), role) for role, pattern, _ in ROLES)], None)


def is_penalty_article(law_name: Column, title: Column, content: Column) -> Column:
    t = collapse(title)
    offence = has(t, OFFENCE_TITLE)
    return (has(collapse(law_name), PENALTY_LAW) & offence) | (offence & has(F.substring(collapse(content), 1, 700), OPERATIVE)) | role_of(title).isNotNull()


def enforcement_reason(question: Column, law_name: Column, title: Column, content: Column, alternative: Column) -> Column:
    """Why an article goes, or empty: coercion first, then generic roles, then specific penalties."""
    role = role_of(title)
    asked = first_of([(role == name, has(question, pattern)) for name, _, pattern in ROLES], F.lit(False))
    wanted = has(question, EXPLICIT_QUESTION) | has(question, IMPLICIT_QUESTION) | has(question, VIOLATION_QUESTION)
    return first_of(
        [
            (has(collapse(title), COERCION_TITLE), F.when(~has(question, COERCION_QUESTION) & alternative, "coercion_not_requested_with_alternative").otherwise("")),
            (role.isNotNull(), F.when(asked, "").otherwise(F.concat(F.lit("generic_"), role, F.lit("_not_requested")))),
            (~is_penalty_article(law_name, title, content), ""),
            (wanted, ""),
            (alternative, "specific_penalty_not_requested_with_alternative"),
        ],
        "",
    )


# --- stages -----------------------------------------------------------------------------------


def drop_invalid(refs: DataFrame, classes: DataFrame, ref_col: str = "article") -> DataFrame:
    """References whose law's class (law_id, class) isn't one of the invalid ones; unknown laws stay."""
    joined = refs.withColumn("_law", law_of(F.col(ref_col))).join(classes.select(F.col("law_id").alias("_law"), F.col("class").alias("_class")), "_law", "left")
    return joined.where(~F.coalesce("_class", F.lit("unknown")).isin(*INVALID_CLASSES)).drop("_law", "_class")


def never_empty(rows: DataFrame, keys: list[str], keep: Column) -> DataFrame:
    """Rows to keep; a key that would lose all of its rows keeps all."""
    flagged = rows.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    kept = F.max("_keep").over(Window.partitionBy(*keys))
    return flagged.withColumn("_any", kept).where(F.col("_keep") | ~F.col("_any")).drop("_keep", "_any")


def guarded_drop(rows: DataFrame, keys: list[str], drop: Column, position: str) -> DataFrame:
    """Rows without those to drop; a key that would lose all of its rows keeps its last."""
    w = Window.partitionBy(*keys)
    flagged = rows.withColumn("_drop", F.coalesce(drop, F.lit(False)))
    flagged = flagged.withColumn("_all", F.min("_drop").over(w)).withColumn("_last", F.max(position).over(w))
    return flagged.where(~F.col("_drop") | (F.col("_all") & (F.col(position) == F.col("_last")))).drop("_drop", "_all", "_last")


def penalty_cleanup(rows: DataFrame) -> DataFrame:
    """(qid, question, law_name, title, ...) without penalty articles that weren't asked for; never empty; adds ``reason``."""
    decided = rows.withColumn("_d", penalty_decision(F.col("question"), F.col("law_name"), F.col("title"))).withColumn("reason", F.col("_d.reason"))
    return never_empty(decided, ["qid"], ~F.col("_d.drop")).drop("_d")


def enforcement_gate(rows: DataFrame) -> DataFrame:
    """(qid, position, question, law_name, title, content) with ``reason`` of those that go; a question keeps one article at least.

    An alternative is an article that is neither about coercion nor about penalties.
    """
    plain = ~has(collapse(F.col("title")), COERCION_TITLE) & ~is_penalty_article(F.col("law_name"), F.col("title"), F.col("content"))
    marked = rows.withColumn("_alternative", F.max(plain).over(Window.partitionBy("qid")))
    reason = enforcement_reason(F.col("question"), F.col("law_name"), F.col("title"), F.col("content"), F.col("_alternative"))
    return guarded_drop(marked.withColumn("reason", reason), ["qid"], F.col("reason") != "", "position").drop("_alternative")


def rescued(final: Column, intents: Column, survivors: Column, depth: int = 3) -> Column:
    """The final list after each intent in turn: one that has no final item among its first ``depth`` adds its first, if that survived and isn't there."""

    def step(now: Column, ranking: Column) -> Column:
        covered = F.arrays_overlap(now, F.slice(ranking, 1, depth))
        top = F.get(ranking, F.lit(0))
        adds = (F.size(ranking) > 0) & ~F.coalesce(covered, F.lit(False)) & F.array_contains(survivors, top) & ~F.array_contains(now, top)
        return F.when(F.coalesce(adds, F.lit(False)), F.concat(now, F.slice(ranking, 1, 1))).otherwise(now)

    return F.aggregate(intents, final, step)
