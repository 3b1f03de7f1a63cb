"""Patterns, labels and messages that results depend on: fixed values, in Java's dialect."""

from __future__ import annotations

# White space as Unicode has it; Java's \s is ASCII only.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"

# Identifiers (ASCII digits and spaces).
RRN = r"(?<!\d)(\d{6})([-\s]?)([0-9]\d{6})(?!\d)"
PHONE = (
    r"(?<!\d)("
    r"01[016789][-\s]?\d{3,4}[-\s]?\d{4}"
    r"|02[-\s]?\d{3,4}[-\s]?\d{4}"
    r"|0[3-6][1-5][-\s]?\d{3,4}[-\s]?\d{4}"
    r"|050\d[-\s]?\d{3,4}[-\s]?\d{4}"
    r"|070[-\s]?\d{3,4}[-\s]?\d{4}"
    r")(?!\d)"
)
CARD = r"(?<!\d)\d{4}([- \s]?)\d{4}\1\d{4}\1\d{4}(?!\d)"
EMAIL = (
    r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9_])"
)
ACCOUNT = r"(?<!\d)(?:\d{1,9}(?:-\d{1,9}){1,4}|\d{10,16})(?!\d)"

# Words looked for around an identifier.
ACCOUNT_WORDS = "(?iu)계좌|계좌번호|가상계좌|입금|출금|송금|이체|예금|은행|환불|account|bank|deposit|transfer|refund"
RRN_WORDS = "(?iu)주민등록|주민번호|등록번호|외국인등록|rrn"
CARD_WORDS = "(?iu)카드|결제|신용|체크|card|credit|debit|payment"
ACCOUNT_WINDOW, RRN_WINDOW, CARD_WINDOW = 24, 18, 24

# Expressions that need review, in order (code, pattern, label).
CLAIMS = [
    ("principal_guarantee", r"원금\s*(?:이\s*)?(?:보장|보전|보호)(?!\s*(?:이\s*|가\s*)?(?:되지\s*않|안\s*(?:됨|되)|불가))", "원금보장 오인 가능 표현"),
    ("guaranteed_return", r"(?:확정|보장)\s*(?:수익|수익률|이자)|(?:수익|수익률|이자)\s*(?:이\s*)?(?:확정|보장)", "확정수익/수익률 보장 표현"),
    (
        "no_loss",
        r"(?:(?:원금\s*)?손실\s*(?:가능성|위험|우려)?\s*(?:이\s*|은\s*|가\s*|도\s*)?(?:전혀\s*)?(?:없[가-힣]*|제로)|무손실|손해\s*(?:가\s*|는\s*)?(?:전혀\s*)?없[가-힣]*)",
        "손실 가능성 축소 표현",
    ),
    ("risk_free", r"(?:무위험|(?:위험|리스크)\s*(?:이\s*|은\s*|가\s*|도\s*)?(?:전혀\s*)?(?:없[가-힣]*|제로))", "위험성 축소 표현"),
    ("high_return_stable", r"(?:안정적\s*)?고수익", "고수익 과장 가능 표현"),
    ("always_profit", r"(?:무조건|반드시|100%)\s*(?:수익|상승|오름)", "단정적 수익 표현"),
]
INTERNAL = r"대외비|내부자료|사외반출금지|미공개|발간\s?전(?![가-힣])|공개\s?전(?![가-힣])|confidential"

# Risk signals, in order.
SIGNALS = {
    "미공개/발표 전 정보": r"미공개|발표\s*전|공개\s*전|내부\s*자료|대외비|confidential",
    "실적/재무 전망": r"실적|매출|영업이익|순이익|손익|전망|가이던스|forecast",
    "투자·출자/M&A": r"투자\s*계획|신규\s*투자|시설\s*투자|출자|타법인|지분\s*취득|합병|분할|인수|m&a|유상\s*증자|증자|감자|신규\s*사업",
    "회계 관련": r"회계|회계\s*처리|재무제표|감사\s*의견|분식|충당금|손상",
    "투자권유/수익 표현": r"투자\s*권유|추천|목표가|(?:수익|수익률|이자)\s*(?:확정|보장)|수익률|원금\s*(?:보장|보전|보호)|(?:확정|보장)\s*(?:수익|수익률|이자)|무손실|손실\s*(?:이\s*|은\s*)?(?:없음|제로)|무위험|위험\s*(?:이\s*|은\s*)?(?:없음|제로)|(?:안정적\s*)?고수익|(?:무조건|반드시)\s*수익",
    "공시/중요 경영사항": r"공시|합병|분할|인수|증자|감자|배당|신규\s*사업",
    "개인/신용정보": r"개인정보|신용정보|주민등록|계좌|전화번호|이메일",
    "정보교류 차단": r"정보\s*교류|차단벽|chinese\s*wall",
}
# Review criteria (number, name, signals).
CRITERIA = [
    ("1호", "재무구조", ["실적/재무 전망"]),
    ("2호", "", []),
    ("3호", "", []),
    ("4호", "", []),
    ("5호", "투자·출자", ["투자·출자/M&A"]),
    ("6호", "손익구조", ["실적/재무 전망"]),
    ("7호", "회계처리", ["회계 관련"]),
    ("8호", "", []),
]
# A call for review, articles and their headers, clause marks.
REVIEW = r"준법감시(?:인|부서)?\s*(?:의\s*)?(?:확인|검토)|사전\s*확인|확인(?:이|가)?\s*필요|검토(?:가)?\s*필요|위험\s*신호|공시\s*위험"
ARTICLE = r"제\s*(\d+)\s*조(?:\s*의\s*(\d+))?"
HEADER = r"제\s*(\d+)\s*조(의\s*\d+)?\s*\(([^)]*)\)"
CLAUSE = "[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]"


def unicode_pattern(pattern: str, ignore_case: bool = True) -> str:
    r"""A pattern without ASCII flag: Unicode \s and \d, Unicode case folding."""
    return ("(?iu)" if ignore_case else "") + pattern.replace(r"\s", WS).replace(r"\d", r"\p{Nd}")
