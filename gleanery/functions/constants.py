"""Fixed values that results depend on."""

# Words dropped from cleaned texts besides the language's stop words.
CUSTOM_STOP_WORDS = (
    "ufro", "duoc", "duocuc", "inacap", "aiep", "santo", "tomás", "tomas",
    "cft", "ip", "ceduc", "ucn", "ipchile", "uss", "unab", "udp", "pucv",
    "usm", "usach", "uchile", "udla", "ucsc", "ubo", "uoh", "ugm",
    "universidad", "instituto", "centro", "carrera", "programa", "malla",
    "admisión", "admision", "académico", "académica", "institucional",
    "universitario", "universitaria", "educación", "educacion", "promoción",
    "promocion", "director", "directora", "jefatura", "alumno", "estudiante",
    "egresado", "egresada", "titulado", "titulada", "título", "titulo",
    "licenciado", "licenciada", "licenciatura", "magíster", "magister",
    "doctor", "doctora", "doctorado", "phd",
    "ingeniería", "ingenieria", "ingeniero", "ingeniera",
    "civil", "informática", "informatica", "informático", "informatico",
    "computación", "computacion", "ejecución", "ejecucion",
    "profesional", "formación", "formacion", "formar",
    "ámbito", "ambito", "función", "funcion",
    "participar", "in", "chile", "chileno", "chilena", "región", "region", "regional",
    "departamento", "cristiano", "cristiana", "visión", "vision", "identidad", "vida", "principio",
    "persona", "humano", "humana", "respeto",
    "él", "ella", "ello",
)

# Title keywords, first and second choice, and the tags titles and contents may have.
PRIORITY_KEYWORDS = ("perfil de egreso", "perfil del egresado", "perfil profesional", "qué aprenderás", "sobre la carrera")
SECONDARY_KEYWORDS = ("competencias", "el titulado", "descripción de la carrera", "campo ocupacional", "campo laboral", "desempeño profesional")
TITLE_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "strong", "b", "span")
CONTENT_TAGS = ("p", "ul", "ol", "li", "div")
STOP_TAGS = ("h1", "h2", "h3")
FALLBACK_TAGS = ("p", "ul", "ol", "div")

# Signs of text decoded with the wrong charset; the last one only where a page is read.
MOJIBAKE = "Ã|Â|â"
MOJIBAKE_PAGE = "Ã|Â|â|�"

# The label rule (keyword, label), its default, and programmes that are left out.
LABEL_RULES = (("civil", "Civil"), ("ejecu", "Ejecución"))
LABEL_DEFAULT = "Informática"
TECHNICIAN = r"^\s*t[eé]cnico\b"
ANALYST = r"\banalista\b"

# Columns of a raw profile, in order.
PROFILE_COLUMNS = ("universidad", "tipo_institucion", "carrera", "tipo_carrera", "url", "selector", "metodo_usado", "perfil_egreso", "error")
SHORT_PROFILE = 150

# Vectors, keyness, tests and models.
MIN_DF, MAX_DF, MAX_TERMS = 2, 0.85, 400
MIN_SUPPORT_DOCS, MIN_SUPPORT_SHARE, TOP_TERMS, CHART_TERMS = 2, 0.10, 15, 10
PERMUTATIONS, SEED, ALPHA, FOLDS, NEIGHBOURS = 1000, 42, 0.05, 5, 3
