"""Column expressions over text: stripping, numbers and dates in cells, language, labels, display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of Unicode, wider than that of SQL's trim.
_SPACE = r"[\s\x0b\p{Z}\u0085\u001c-\u001f]"
_NUMBER = r"^[+-]?(?:(?:[0-9]+(?:_[0-9]+)*)(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?$"
_SPECIAL = r"^[+-]?(?i:nan|inf|infinity)$"

# How the original product shows things.
STATUS_TEXT = {"uploaded": "等待处理", "processing": "处理中", "completed": "已完成", "failed": "处理失败"}
STATUS_MESSAGE = {"uploaded": "📄 等待开始GraphRAG处理...", "processing": "🚀 正在进行GraphRAG处理...", "completed": "✅ 处理完成", "failed": "❌ 处理失败"}
PROGRESS_BANDS = [(5, "🚀 正在启动GraphRAG处理..."), (30, "📖 正在提取PDF内容..."), (50, "🔤 正在生成嵌入向量..."), (65, "💾 正在保存向量数据..."), (86, "🧠 正在构建知识图谱..."), (99, "🕸️ 正在保存图数据...")]
PROGRESS_LAST, PROGRESS_UPLOADED = "🎉 即将完成...", "📄 准备开始GraphRAG处理..."
KIND_NAMES = {"image": "图片", "table": "表格", "chart": "图表"}
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp"}
DATES = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{4}年\d{1,2}月\d{1,2}日)"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{_SPACE}+|{_SPACE}+\z", "")


def blank(x: Column) -> Column:
    return F.length(strip(x)) == 0


def _plain_number(x: Column) -> Column:
    return strip(F.regexp_replace(x, "[,%]", ""))


def is_number(x: Column) -> Column:
    """As a float is read from text, after commas and percent signs: underscores between digits, nan and inf count."""
    n = _plain_number(x)
    return F.coalesce(n.rlike(_NUMBER) | n.rlike(_SPECIAL), F.lit(False))


def to_number(x: Column) -> Column:
    """The number that a cell holds, or null."""
    n = _plain_number(x)
    return F.when(n.rlike(_SPECIAL), F.regexp_replace(F.lower(n), "^([+-]?)inf$", "$1infinity").try_cast("double")).when(n.rlike(_NUMBER), F.replace(n, F.lit("_"), F.lit("")).try_cast("double"))


def is_date(x: Column) -> Column:
    return F.coalesce(x.rlike(DATES), F.lit(False))


def language(x: Column, share: float = 0.3) -> Column:
    """zh if over `share` of the letters are unified ideographs, else en."""
    letters = F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
    ideographs = F.length(F.regexp_replace(x, "[^一-鿿]", ""))
    return F.when((letters > 0) & (ideographs / F.greatest(letters, F.lit(1)) > share), F.lit("zh")).otherwise(F.lit("en"))


def sanitise(x: Column, prefix: str) -> Column:
    """A label of ASCII letters, digits and underscores, in upper case, that starts with a letter."""
    s = F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9_]", "_")
    return F.upper(F.when(s == "", F.lit(prefix + "UNKNOWN")).when(s.rlike("^[A-Za-z]"), s).otherwise(F.concat(F.lit(prefix), s)))


def mapped(x: Column, values: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(x == k, F.lit(v)).otherwise(out)
    return out


def kind_name(x: Column) -> Column:
    """How a kind of content is shown; an unknown one as it is."""
    return F.coalesce(F.create_map(*[F.lit(v) for pair in KIND_NAMES.items() for v in pair])[x], x)


def iso_time(ts: Column) -> Column:
    """Date and time as ISO 8601 text, with microseconds where there are any."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(ts, "SSSSSS") != "000000", F.date_format(ts, ".SSSSSS")).otherwise(F.lit("")))


def two_decimals(x: Column) -> Column:
    """A double with two decimals, rounded by its exact value, ties to the even digit; the usual formats round its shortest decimal form, ties up."""
    whole = F.floor(F.abs(x))
    f = F.abs(x) - whole
    high = f * 134217729.0 - (f * 134217729.0 - f)  # the upper half of the digits, so that both products are exact
    q = f * 100.0
    rest = (high * 100.0 - q) + (f - high) * 100.0  # what rounding took from q
    tie = (q - F.floor(q)) == 0.5
    n = F.when(tie & (rest > 0), F.floor(q) + 1).when(tie & (rest < 0), F.floor(q)).otherwise(F.rint(q)).cast("bigint")
    exact = F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), (whole + F.floor(n / 100)).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    return F.when(F.abs(x) < 1e15, exact).otherwise(F.format_string("%.2f", x))


def human_size(n: Column) -> Column:
    def in_unit(unit: int, name: str) -> Column:
        return F.concat(F.regexp_replace(F.round(n / float(unit), 2).cast("string"), r"\.0$", ""), F.lit(name))

    return F.when(n == 0, F.lit("0 B")).when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, in_unit(1 << 10, " KB")).when(n < 1 << 30, in_unit(1 << 20, " MB")).otherwise(in_unit(1 << 30, " GB"))


def relative_time(seconds: Column, absolute: Column) -> Column:
    """From the age in seconds; a day or more gives the absolute form."""
    return F.when(seconds < 60, F.lit("刚刚")).when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("分钟前"))).when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("小时前"))).otherwise(absolute)


def progress_message(status: Column, progress: Column) -> Column:
    band = F.lit(PROGRESS_LAST)
    for upto, text in reversed(PROGRESS_BANDS):
        band = F.when(progress <= upto, F.lit(text)).otherwise(band)
    return F.when(status == "uploaded", F.lit(PROGRESS_UPLOADED)).when(status == "processing", band).when(status == "completed", F.lit(STATUS_MESSAGE["completed"])).when(status == "failed", F.lit(STATUS_MESSAGE["failed"])).otherwise(F.concat(progress.cast("string"), F.lit("%")))


def data_uri(payload: Column, extension: Column) -> Column:
    return F.concat(F.lit("data:"), mapped(F.lower(extension), MIME, "image/png"), F.lit(";base64,"), F.base64(payload))


def query_terms(query: Column, longer_than: int = 2, most: int = 3) -> Column:
    """The first words of more than two characters, in order, repeats kept."""
    words = F.split(strip(query), rf"{_SPACE}+")
    return F.slice(F.filter(words, lambda w: F.length(w) > longer_than), 1, most)


def valid_question(query: Column, most: int = 1000) -> Column:
    """Whether a question says something, in at most a thousand characters."""
    return F.coalesce((F.length(strip(query)) > 0) & (F.length(strip(query)) <= most), F.lit(False))


def page_progress(page: Column, total: Column, part: float) -> Column:
    return (5 + F.floor((page + F.lit(part)) / total * 25)).cast("int")


def stage_progress(start: int, width: int, done: Column, total: Column) -> Column:
    return (start + F.floor(done / total * width)).cast("int")


def upload_checks(name: Column, size: Column, allowed=("pdf",), most: int = 100 << 20) -> tuple[Column, Column]:
    """Whether the extension is allowed and whether the size is."""
    return F.contains(name, F.lit(".")) & F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*allowed), size <= most


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of floats, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
