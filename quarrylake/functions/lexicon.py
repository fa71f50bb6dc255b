"""The patterns and vocabularies that define findings in report texts. They must equal the data model's."""

FDI = r"(?<!\d)([1-4])\s*[.]?\s*([1-8])(?!\d)"
FDI_RANGE = r"(?<!\d)([1-4])\s*[.]?\s*([1-8])\s*(?:-|–|—|\bto\b|\bthrough\b)\s*(?:(?:([1-4])\s*[.]?\s*)?([1-8]))(?!\d)"
INVALID_DECIMAL_FDI = r"(?<!\d)([1-4])\s*\.\s*(\d{1,2})(?!\d)"
WORD = r"[a-z0-9]+"
NO_WORD = r"[^a-z0-9]+"
NEGATION = r"\b(?:no|not|without|absent|absence of|no evidence of|no definite|negative for)\b"
NEGATED_MISSING = r"\b(?:no|without)\s+(?:evidence of\s+)?(?:missing|absent)\b"
COVERAGE = (
    r"\b(?:scan|acquisition|field of view|volume|available scans?|included|excluded|"
    r"not visible|not assessable|non[- ]evaluable|partially visuali[sz]ed)\b"
)
VISIBILITY = r"\b(?:included|excluded|visible|assessable|visuali[sz]ed|field of view|volume)\b"
CONCEPTS = {
    "missing": r"\b(?:missing|absen(?:t|ce)|edentulous|not present)\b",
    "impacted": r"\b(?:impact(?:ed|ion)|unerupted|retained tooth)\b",
    "root_canal": r"\b(?:root canal|endodontic(?:ally)?(?: treated| treatment)?|root[- ]filled)\b",
    "implant": r"\b(?:implant|implant-supported)\b",
    "lesion": r"\b(?:lesion|osteolytic|osteocondensing|radiolucen\w*|radiopaqu\w*|periapical\s+(?:pathology|lesion)|osteorarefaction)\b",
    "bone_loss": r"\b(?:bone (?:loss|atrophy)|alveolar atrophy|periodontal loss)\b",
    "calculus": r"\b(?:calculus|calcification|calcified deposit)\w*\b",
    "caries": r"\b(?:caries|carious|dental decay)\b",
    "prosthesis": r"\b(?:prosthes\w*|restoration|crown|bridge)\b",
    "extraction_socket": r"\b(?:extraction|post-extraction|extraction socket)\b",
    "mandibular_canal": r"\bmandibular canal\b",
    "sinus": r"\b(?:maxillary )?sinus(?:es)?\b",
    "tmj": r"\b(?:temporomandibular joint|TMJ|mandibular condyle)\w*\b",
}
ANATOMY = {
    "mandibular_canal": r"\bmandibular canal\b",
    "maxillary_sinus": r"\bmaxillary sinus(?:es)?\b",
    "tmj": r"\b(?:temporomandibular joint|TMJ|mandibular condyle)\w*\b",
    "mandible": r"\bmandib(?:le|ular)\b",
    "maxilla": r"\bmaxill(?:a|ary)\b",
}
PRESENCE = r"\b(?:present|presence of|identified|noted|demonstrated|shows?|contains?)\b"
CLAUSE_BREAK = r"(?:\r?\n)+|(?<=[.!?;])\s+"
TOOTH_CONCEPTS = ("missing", "impacted", "root_canal", "implant", "prosthesis", "caries")
CASE_CONCEPTS = ("lesion", "bone_loss", "calculus", "extraction_socket", "mandibular_canal", "sinus", "tmj")
LABELLED_CONCEPTS = ("missing", "impacted", "root_canal", "implant")
TEETH = [f"{q}{p}" for q in range(1, 5) for p in range(1, 9)]
