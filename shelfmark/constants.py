"""Word lists, lookup tables, column lists and texts.

All of them must equal the values the described catalog data was produced with, so they are
stated as plain literals. Where the order matters (first match wins) it is the order below.
"""

# Declared raw catalog columns.
RAW_COLUMNS = [
    "id", "platform", "title", "description", "category", "skills", "instructor", "rating",
    "num_reviews", "price", "level", "language", "duration", "url", "image_url", "scraped_at",
]

# Alias columns, (existing column, column to add when absent).
COLUMN_ALIASES = [
    ("id", "course_id"),
    ("partner", "instructor"),
    ("link", "url"),
    ("source_domain", "platform"),
    ("title_clean", "combined_text"),
]

# Category by title keyword, first class with a hit wins.
TITLE_CATEGORIES = [
    ("Data Science", ["data science", "data analytics", "data analysis", "big data"]),
    ("Machine Learning", ["machine learning", "ml ", "deep learning", "neural network"]),
    ("Programming", ["python", "java", "javascript", "programming", "coding", "developer"]),
    ("Web Development",
     ["web development", "web design", "html", "css", "react", "angular", "vue"]),
    ("Business",
     ["business", "management", "marketing", "finance", "accounting", "entrepreneurship"]),
    ("Design", ["design", "photoshop", "illustrator", "ui", "ux", "graphic"]),
    ("IT & Software",
     ["software", "cloud", "aws", "azure", "devops", "docker", "kubernetes"]),
    ("Health & Fitness",
     ["health", "fitness", "yoga", "nutrition", "medical", "healthcare"]),
    ("Personal Development", ["leadership", "productivity", "communication", "career"]),
]

# Level by metadata keyword, first hit wins.
METADATA_LEVELS = [
    ("Beginner", ["beginner"]),
    ("Intermediate", ["intermediate"]),
    ("Advanced", ["advanced"]),
]

# Canonical category by substring, first hit wins.
CATEGORY_MAPPING = [
    ("data science", "Data Science"),
    ("data-science", "Data Science"),
    ("data analytics", "Data Science"),
    ("data analysis", "Data Science"),
    ("big data", "Data Science"),
    ("machine learning", "Machine Learning"),
    ("machine-learning", "Machine Learning"),
    ("ml", "Machine Learning"),
    ("artificial intelligence", "Artificial Intelligence"),
    ("artificial-intelligence", "Artificial Intelligence"),
    ("ai", "Artificial Intelligence"),
    ("deep learning", "Deep Learning"),
    ("deep-learning", "Deep Learning"),
    ("neural networks", "Deep Learning"),
    ("python", "Python Programming"),
    ("python programming", "Python Programming"),
    ("javascript", "JavaScript"),
    ("java", "Java Programming"),
    ("web development", "Web Development"),
    ("web-development", "Web Development"),
    ("frontend", "Web Development"),
    ("backend", "Web Development"),
    ("full stack", "Web Development"),
    ("cloud computing", "Cloud Computing"),
    ("cloud-computing", "Cloud Computing"),
    ("aws", "Cloud Computing"),
    ("azure", "Cloud Computing"),
    ("gcp", "Cloud Computing"),
    ("cybersecurity", "Cybersecurity"),
    ("cyber security", "Cybersecurity"),
    ("security", "Cybersecurity"),
    ("business", "Business"),
    ("management", "Business"),
    ("entrepreneurship", "Business"),
    ("marketing", "Marketing"),
    ("digital marketing", "Marketing"),
    ("finance", "Finance"),
    ("financial", "Finance"),
    ("accounting", "Finance"),
]

# Canonical level by substring, first hit wins.
LEVEL_MAPPING = [
    ("beginner", "Beginner"),
    ("débutant", "Beginner"),
    ("introductory", "Beginner"),
    ("basic", "Beginner"),
    ("intermediate", "Intermediate"),
    ("intermédiaire", "Intermediate"),
    ("medium", "Intermediate"),
    ("advanced", "Advanced"),
    ("avancé", "Advanced"),
    ("expert", "Advanced"),
    ("professional", "Advanced"),
    ("all levels", "All Levels"),
    ("tous niveaux", "All Levels"),
    ("mixed", "All Levels"),
]

# Defaults for missing cells.
CLEAN_DEFAULTS = {
    "platform": "Unknown",
    "title": "",
    "description": "",
    "category": "Other",
    "skills": "",
    "instructor": "Unknown",
    "rating": 0.0,
    "num_reviews": 0,
    "price": "Subscription",
    "level": "All Levels",
    "language": "English",
    "url": "",
}

# Level keywords on a tag list (case-sensitive, first hit wins).
TAG_LEVELS = ["All Levels", "Beginner", "Intermediate", "Advanced", "Expert"]

# Bilingual level keywords on card text (first class with a hit wins).
CARD_LEVELS = [
    ("Beginner", ["débutant", "beginner", "introduct", "basic"]),
    ("Intermediate", ["intermédiaire", "intermediate", "medium"]),
    ("Advanced", ["avancé", "advanced", "expert", "professional"]),
]

# Numeric codes.
PLATFORM_CODES = {"Coursera": 1, "Udemy": 2}
LEVEL_CODES = {"Beginner": 1, "Intermediate": 2, "Advanced": 3, "All Levels": 0}
# Second level code, used by learning path B: 0 Beginner, 1 All Levels, 2 Intermediate, 3 Advanced.
PATH_LEVEL_CODES = {"Beginner": 0, "All Levels": 1, "Intermediate": 2, "Advanced": 3}
PATH_LEVELS = ["Beginner", "Intermediate", "Advanced"]
LEVEL_ENC_LABELS = {0: "Tous niveaux", 1: "Débutant", 2: "Intermédiaire", 3: "Avancé"}

# Price texts.
MISSING_PRICE = "19.99$"
COURSERA_PRICE = "Inscrivez-vous gratuitement"

# Feature columns.
FEATURE_COLUMNS = [
    "platform_encoded", "level_encoded", "price_encoded", "rating_normalized",
    "reviews_normalized", "popularity_score",
]

# English stop words of the text cleaner.
STOPWORDS_EN = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "as", "is", "was", "are", "were", "been",
    "be", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "shall", "can", "need", "this", "that",
    "these", "those", "i", "you", "he", "she", "it", "we", "they", "what",
    "which", "who", "when", "where", "why", "how", "all", "each", "every",
    "both", "few", "more", "most", "other", "some", "such", "no", "not",
    "only", "same", "so", "than", "too", "very", "just", "about", "into",
    "through", "during", "before", "after", "above", "below", "between",
    "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own",
    "same", "so", "than", "too", "very", "course", "learn", "learning",
    "complete", "introduction", "guide", "tutorial", "masterclass",
]

# French stop words of the text cleaner.
STOPWORDS_FR = [
    "le", "la", "les", "un", "une", "des", "du", "de", "et", "ou", "mais",
    "dans", "sur", "à", "pour", "avec", "par", "ce", "cette", "ces",
    "il", "elle", "nous", "vous", "ils", "elles", "être", "avoir",
    "que", "qui", "quoi", "dont", "où", "si", "ne", "pas", "plus",
    "cours", "apprendre", "introduction", "guide", "tutoriel",
]

# Generic catalog words ignored by the cluster features.
DOMAIN_STOPWORDS = [
    "course", "introduction", "complete", "specialization", "partner", "instructor", "level",
    "title", "category", "professional", "certificate", "training", "master", "guide", "weeks",
    "months", "beginner", "intermediate", "advanced", "all levels",
]

# Retrieval and clustering parameters.
TFIDF_MAX_FEATURES = 5000
TFIDF_MIN_DF = 2
TFIDF_MAX_DF = 0.95
CLUSTER_MAX_FEATURES = 2000
N_CLUSTERS = 24
N_INIT = 10
SEED = 42


def nlp_stop_words() -> list[str]:
    """English and French stop words of the text cleaner, without repeats."""
    return list(dict.fromkeys(STOPWORDS_EN + STOPWORDS_FR))


def cluster_stop_words(base: list[str] | None = None) -> list[str]:
    """Union of a base stop list and the generic catalog words."""
    return list(dict.fromkeys((nlp_stop_words() if base is None else base) + DOMAIN_STOPWORDS))
