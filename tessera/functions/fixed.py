"""Word lists, maps and patterns that results depend on."""

from __future__ import annotations

# Stop-words of document keywords.
KEYWORD_STOP_WORDS = """
the and for are but not you all can had her was one our out has have been some them than its over such that this with
from they will each make like more also
và của các có cho với được trong một những khi về đến làm này nên nhiều theo sau trên dưới giữa hoặc không nếu rằng từ đã
sẽ đang bị bởi tại vào ra lên xuống qua lại cùng ngày tháng năm
""".split()

# Stop-words of concept keywords.
CONCEPT_STOP_WORDS = """
và của có trong cho với được các một như khi về để từ ở vào này đó là không ngày tháng năm việc người thời gian tại theo
sau trước trên dưới giữa mỗi những đã đang sẽ bị ra
the and for that this with from have will been their they them what which are was were being has had did does done doing
would could should can may might shall about into over after before between under again further then once
please thanks thank br regards best dear hello hi sent com http https www email
""".split()

# Stop-words of response attribution.
RESPONSE_STOP_WORDS = "the a an is are was were in on at to for of with by and or but not".split()

# Topics, each with the substrings that tell it.
TOPICS = {
    "ai_ml": ["AI", "artificial intelligence", "machine learning", "deep learning", "LLM", "large language model", "model training", "inference", "neural network", "transformer", "embedding", "vector database", "RAG", "retrieval augmented generation", "fine-tuning", "prompt"],
    "data_engineering": ["data pipeline", "ETL", "data lake", "data warehouse", "bronze", "silver", "gold", "medallion", "data platform", "data integration", "data ingestion", "data quality", "batch processing", "stream processing", "real-time"],
    "schedule_planning": ["lịch", "schedule", "meeting", "họp", "standup", "deadline", "due", "milestone", "timeline", "calendar", "appointment", "kế hoạch", "lên lịch", "hạn chót"],
    "development": ["code", "dev", "deploy", "build", "test", "CI/CD", "git", "feature", "bug", "fix", "release", "version", "sprint", "pull request", "code review", "refactor", "pipeline"],
    "security": ["security", "bảo mật", "password", "auth", "token", "credential", "encryption", "OAuth", "JWT", "SSL", "firewall", "vulnerability", "access control", "RBAC"],
    "education": ["tốt nghiệp", "graduation", "sinh viên", "student", "class", "course", "học", "trường", "university", "bachelor", "master", "PhD", "certification", "training"],
    "business": ["contest", "competition", "prize", "grant", "funding", "investor", "startup", "revenue", "profit", "cost", "budget", "contract", "client", "customer", "partner"],
    "finance": ["invoice", "payment", "transaction", "bank", "account", "tax", "audit", "financial", "budget", "expense", "hóa đơn", "thanh toán", "tài chính", "ngân sách"],
    "healthcare": ["health", "medical", "bệnh", "hospital", "doctor", "patient", "treatment", "diagnosis", "clinical", "sức khỏe", "y tế", "bệnh viện"],
    "technology": ["cloud", "microservice", "container", "Docker", "Kubernetes", "serverless", "API", "database", "cache", "queue", "monitoring", "observability", "telemetry", "logging"],
    "legal_compliance": ["compliance", "regulation", "GDPR", "policy", "legal", "agreement", "NDA", "license", "terms of service", "privacy", "data protection", "tuân thủ", "pháp lý"],
}

# Content types in order of precedence, each with the substrings that score for it.
CONTENT_TYPES = {
    "schedule": ["lịch", "schedule", "meeting", "appointment", "calendar", "work plan", "lam viec", "lich", "thời gian", "kế hoạch", "lịch trình", "agenda"],
    "invoice": ["invoice", "hóa đơn", "bill", "payment", "thanh toán", "receipt", "hoa don", "total", "subtotal", "vat"],
    "report": ["report", "báo cáo", "summary", "baocao", "kpi", "analysis", "tong hop", "kết quả", "result"],
    "contract": ["contract", "hợp đồng", "agreement", "thỏa thuận", "hopdong", "signed", "ký kết", "điều khoản"],
    "personal": ["personal", "cá nhân", "letter", "thư", "giới thiệu", "cv", "resume", "sơ yếu"],
}

# The accented letters that count towards Vietnamese.
VIETNAMESE = "àáảãạâầấẩẫậăằắẳẵặèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"

# Patterns of project names; more than one group joins with a space.
PROJECT_PATTERNS = [
    (r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(Project|Platform|Pipeline|System|Engine|Agent|API)\b", 2),
    (r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(Dự án|Hệ thống|Nền tảng)\b", 2),
    (r"\b(AI|ML|LLM|API|UI|UX|DB|SQL|NLP|RAG|KG)\s*", 1),
    (r"\b(LangGraph|LangChain|FastAPI|PostgreSQL|MinIO|SQLAlchemy|Alembic|Docker|Python|Gmail|Gemini|Vertex|Kafka|Redis|Elasticsearch|Kubernetes)\b", 1),
    (r"\b([A-Z][a-z]+)\s+([0-9]+)\s*(Project|Platform)?\b", 3),
]

# Patterns of entities, and the group that is reported.
ENTITY_PATTERNS = {
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0),
    "url": (r"(?i)\bhttps?://[^\s,;]+", 0),
    "phone": (r"\b(\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}\b", 1),
    "date_iso": (r"\b\d{4}-\d{2}-\d{2}\b", 0),
    "date_vn": (r"\b\d{2}/\d{2}/\d{4}\b", 0),
    "currency": (r"\b[\$\€\£\¥]\s*\d+(?:\.\d{1,2})?\b", 0),
}
VERSION_PATTERN = r"\bv?\d+\.\d+(?:\.\d+)?(?:-[a-zA-Z0-9]+)?\b"
FILE_PATTERN = r"\b[\w\-]+\.(py|js|ts|java|go|rs|yaml|yml|json|xml|md|txt|csv|docx|pdf|xlsx)\b"

# Patterns of dates.
DATE_PATTERNS = [
    r"\d{1,2}/\d{1,2}/\d{2,4}",
    r"\d{4}-\d{2}-\d{2}",
    r"\d{1,2}-\d{1,2}-\d{4}",
    r"(Ngày|ngày|Date|date)\s+(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})",
    r"(?i)(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*",
    r"(?iu)(Tháng|thang|Thg|thg)\s*\d{1,2}",
]

# Categories of files, types of nodes, and media types by extension.
FILE_CATEGORIES = {".pdf": "document", ".doc": "document", ".docx": "document", ".txt": "text", ".xls": "spreadsheet", ".xlsx": "spreadsheet", ".png": "image", ".jpg": "image", ".jpeg": "image", ".gif": "image"}
NODE_TYPES = {
    ".docx": ("document", "report"), ".doc": ("document", "report"), ".pdf": ("document", "report"), ".txt": ("document", "note"),
    ".csv": ("resource", "dataset"), ".xlsx": ("resource", "spreadsheet"), ".xls": ("resource", "spreadsheet"), ".json": ("document", "data"),
    ".md": ("document", "note"), ".pptx": ("document", "presentation"), ".ppt": ("document", "presentation"), ".html": ("document", "webpage"), ".htm": ("document", "webpage"),
}
MEDIA_TYPES = {
    ".pdf": "application/pdf",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".txt": "text/plain",
    ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".csv": "text/csv",
    ".json": "application/json",
}
