"""Rule tables of the news operators. All of them are fixed values, in the order in which they apply."""

from __future__ import annotations

# Words that are looked for in lower-cased text. A word that stands twice in a list counts twice.
POSITIVE = [
    "approval", "approved", "positive", "met primary", "met its primary", "statistically significant", "breakthrough", "fast track",
    "priority review", "orphan drug", "successful", "success", "license agreement", "partnership", "collaboration", "milestone payment",
    "acquisition", "merger", "허가", "승인", "긍정", "유효성", "통계적 유의", "기술수출", "라이선스", "계약 체결", "임상 성공", "목표 달성",
    "승인", "허가", "긍정", "유효성", "통계적 유의", "기술수출", "기술이전", "라이선스", "계약 체결", "임상 성공", "목표 달성", "품목허가",
    "우선심사", "혁신신약", "연구 결과", "특허", "독점",
]
NEGATIVE = [
    "complete response letter", "crl", "clinical hold", "failed", "failure", "missed primary", "did not meet", "adverse event", "serious adverse",
    "terminated", "discontinued", "safety concern", "warning letter", "recall", "rejected", "denied", "downgrade", "임상 중단", "임상 실패",
    "목표 미달", "안전성", "중대한 이상반응", "반려", "거절", "회수", "경고", "임상 중단", "임상 실패", "목표 미달", "안전성", "중대한 이상반응",
    "반려", "거절", "회수", "경고", "판매중지", "허가 취소",
]
FINANCING = [
    "public offering", "registered direct", "private placement", "at-the-market", "atm offering", "convertible", "warrant", "dilution",
    "shelf registration", "424b5", "s-3", "유상증자", "전환사채", "신주인수권", "제3자배정", "증권신고서", "주식 발행", "희석", "유상증자",
    "전환사채", "신주인수권", "제3자배정", "증권신고서", "주식 발행", "자금조달",
]
TRIAL = [
    "phase 1", "phase i", "phase 2", "phase ii", "phase 3", "phase iii", "clinical trial", "topline", "top-line", "primary endpoint",
    "secondary endpoint", "patient enrollment", "임상 1상", "임상1상", "임상 2상", "임상2상", "임상 3상", "임상3상", "임상시험", "탑라인", "유효성",
    "임상 1상", "임상1상", "임상 2상", "임상2상", "임상 3상", "임상3상", "임상시험", "톱라인", "주요평가변수", "환자 등록",
]
REGULATORY = [
    "fda", "ema", "nda", "bla", "ind", "pdufa", "approval", "crl", "clinical hold", "식약처", "품목허가", "허가 신청", "허가 승인",
    "임상시험계획", "ind 승인", "식약처", "품목허가", "허가 신청", "허가 승인", "임상시험계획", "ind 승인",
]
DEALS = [
    "merger", "acquisition", "acquire", "tender offer", "strategic alternatives", "합병", "인수", "피인수", "공개매수", "경영권", "합병", "인수",
    "피인수", "공개매수", "경영권",
]
EARNINGS = [
    "earnings", "revenue", "guidance", "quarter results", "financial results", "eps", "실적", "매출", "영업이익", "당기순이익", "잠정실적",
    "가이던스", "실적", "매출", "영업이익", "분기 실적", "잠정실적", "가이던스",
]
#: Event types in the order in which equal counts are decided.
EVENT_TYPES = [
    ("REGULATORY", REGULATORY), ("CLINICAL", TRIAL), ("FINANCING", FINANCING), ("M&A", DEALS), ("EARNINGS", EARNINGS), ("NEGATIVE_SAFETY", NEGATIVE),
]
#: Filing forms that are material in themselves and speak for financing with three words.
FINANCING_FORMS = ["S-3", "S-3ASR", "424B3", "424B5"]

# Topics and the phrases of which one must occur, in the order of precedence.
TOPICS = [
    ("FDA_REJECTION_CRL", ["complete response letter", " crl ", "fda reject", "approval denied", "fda 거절", "허가 거절", "보완요구서"]),
    ("FDA_APPROVAL", ["fda approval", "fda approves", "approved by the fda", "regulatory approval", "fda 승인", "품목허가", "신약 허가"]),
    ("CLINICAL_HOLD", ["clinical hold", "partial clinical hold", "trial hold", "임상 중단", "임상시험 중단", "임상 보류"]),
    ("ENDPOINT_MISSED", ["missed endpoint", "did not meet", "failed to meet", "endpoint was not met", "평가지표 미충족", "목표 미달", "유효성 입증 실패"]),
    ("ENDPOINT_MET", ["met endpoint", "achieved endpoint", "endpoint was met", "평가지표 충족", "1차 지표 충족", "유효성 입증"]),
    ("TRIAL_NEGATIVE", ["trial failed", "negative results", "no statistically significant", "study discontinued", "임상 실패", "부정적 결과", "통계적 유의성 미달"]),
    ("TRIAL_POSITIVE", ["positive results", "positive topline", "statistically significant", "promising results", "임상 성공", "긍정적 결과", "통계적 유의성 확보"]),
    ("SAFETY_SIGNAL", ["safety signal", "adverse event", "serious adverse", "toxicity", "patient death", "안전성 우려", "이상반응", "중대한 이상", "독성"]),
    ("PHASE3", ["phase 3", "phase iii", "pivotal trial", "임상 3상", "3상 임상"]),
    ("PHASE2", ["phase 2", "phase ii", "임상 2상", "2상 임상"]),
    ("PHASE1", ["phase 1", "phase i", "first-in-human", "임상 1상", "1상 임상"]),
    ("OFFERING", ["public offering", "registered direct offering", "underwritten offering", "유상증자", "제3자배정", "주식 공모"]),
    ("ATM", ["at-the-market", "at the market offering", "sales agreement", "시장가 발행"]),
    ("CONVERTIBLE", ["convertible note", "convertible senior", "convertible debt", "전환사채", "교환사채"]),
    ("WARRANT", ["warrant exercise", "purchase warrant", "pre-funded warrant", "신주인수권", "워런트"]),
    ("DILUTION", ["dilution", "dilutive", "shares issued", "주식 희석", "신주 발행"]),
    ("FINANCING", ["financing", "capital raise", "private placement", "자금 조달", "투자 유치", "사모 발행"]),
    ("LICENSING", ["license agreement", "licensing agreement", "exclusive license", "기술이전", "라이선스 계약", "독점 실시권"]),
    ("PARTNERSHIP", ["partnership", "collaboration agreement", "strategic collaboration", "공동개발", "업무협약", "전략적 협력"]),
    ("MILESTONE", ["milestone payment", "development milestone", "commercial milestone", "마일스톤", "단계별 기술료"]),
    ("M_AND_A", ["acquisition", "merger agreement", "to acquire", "takeover", "인수합병", "합병 계약", "경영권 인수"]),
    ("EARNINGS", ["quarterly results", "financial results", "earnings", "net loss", "분기 실적", "영업이익", "영업손실", "순손실"]),
    ("GUIDANCE", ["guidance", "outlook", "financial forecast", "실적 전망", "매출 전망", "가이던스"]),
    ("MANAGEMENT", ["chief executive officer", "chief financial officer", "appoints", "resignation", "대표이사", "최고경영자", "최고재무책임자", "선임", "사임"]),
    ("PATENT", ["patent", "intellectual property", "patent office", "특허 등록", "특허 출원", "지식재산권"]),
    ("MANUFACTURING", ["manufacturing", "production facility", "contract manufacturer", "cmc", "생산시설", "위탁생산", "제조시설", "공장 증설"]),
    ("RECALL", ["recall", "withdrawal from market", "product withdrawal", "제품 회수", "판매 중단", "자진 회수"]),
]

# Publishers, what names them and their class, in the order in which they are tried.
PUBLISHERS = [
    ("Reuters", ["reuters"], "WIRE"),
    ("Associated Press", ["associated press", " ap news", "apnews.com"], "WIRE"),
    ("Bloomberg", ["bloomberg"], "MAJOR_FINANCIAL"),
    ("The Wall Street Journal", ["wall street journal", "wsj.com"], "MAJOR_FINANCIAL"),
    ("CNBC", ["cnbc"], "MAJOR_FINANCIAL"),
    ("Financial Times", ["financial times", "ft.com"], "MAJOR_FINANCIAL"),
    ("Stat News", ["stat news", "statnews"], "BIOTECH_SPECIALIST"),
    ("BioPharma Dive", ["biopharma dive", "biopharmadive"], "BIOTECH_SPECIALIST"),
    ("Fierce Biotech", ["fierce biotech", "fiercebiotech"], "BIOTECH_SPECIALIST"),
    ("BioSpace", ["biospace"], "BIOTECH_SPECIALIST"),
    ("GlobeNewswire", ["globenewswire"], "PR_DISTRIBUTOR"),
    ("Business Wire", ["business wire", "businesswire"], "PR_DISTRIBUTOR"),
    ("PR Newswire", ["pr newswire", "prnewswire"], "PR_DISTRIBUTOR"),
    ("U.S. SEC", ["sec.gov", " sec ", "edgar"], "REGULATORY"),
    ("KIND", ["kind.krx", " kind ", "dart.fss"], "REGULATORY"),
    ("Yahoo Finance", ["yahoo finance", "finance.yahoo"], "AGGREGATOR"),
    ("MSN", [" msn ", "msn.com"], "AGGREGATOR"),
    ("Naver News", ["naver news", "news.naver"], "AGGREGATOR"),
]
ISSUER_WORDS = ["issuer", "company pr", "official press"]
ATTRIBUTIONS = [("Reuters", [" by reuters ", " reporting by reuters ", " reuters "]), ("Associated Press", [" associated press ", " by ap "])]

# Fixed values of the article quality tiers.
UNKNOWN_PUBLISHERS = ["", "unknown", "n/a", "na", "none", "null"]
PRECISE = ["EXACT_SECOND", "EXACT_MINUTE"]
LEAST_HEADLINE, LEAST_BODY = 8, 80
CRAWL_SECONDS, CRAWL_LAG_SECONDS = 5, 3600

# Fixed values of the event features.
PUBLISHER_CLASSES = ["WIRE", "MAJOR_FINANCIAL", "MAJOR_GENERAL", "BIOTECH_SPECIALIST", "ISSUER_OFFICIAL", "PR_DISTRIBUTOR", "REGULATORY", "AGGREGATOR", "OTHER"]
PRECISION_ORDER = {"UNKNOWN": 0, "DATE_ONLY": 1, "HOUR_ONLY": 2, "EXACT_MINUTE": 3, "EXACT_SECOND": 4}
CONFIDENCE_ORDER = {"UNKNOWN": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3}
POSITIVE_TOPICS = ["FDA_APPROVAL", "TRIAL_POSITIVE", "ENDPOINT_MET"]
NEGATIVE_TOPICS = ["FDA_REJECTION_CRL", "TRIAL_NEGATIVE", "ENDPOINT_MISSED", "CLINICAL_HOLD", "SAFETY_SIGNAL", "RECALL"]

# Fixed values of matching a headline within a disclosure: words that tell nothing, window and stride in words.
UNINFORMATIVE = [
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "by", "for", "from", "has", "have", "in", "into", "is", "it", "its", "of", "on", "or",
    "that", "the", "their", "this", "to", "was", "were", "will", "with", "update", "corrected", "rpt", "brief", "factbox", "exclusive", "sources", "says",
    "said", "company", "companies", "corp", "corporation", "inc", "incorporated", "plc", "ltd", "limited", "co", "new", "u", "s", "us",
]
MATCH_WINDOW, MATCH_STRIDE = 160, 40
