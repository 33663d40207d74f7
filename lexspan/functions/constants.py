"""Fixed values that results depend on: branch names, stop words, expansions, cues and families."""

#: Branches: display name and colour by key.
BRANCHES = {
    "ACTOR_PLAYER": ("Actor / Player", "#1e6fa0"),
    "AREA_OF_LAW": ("Area of Law", "#1a5276"),
    "ASSET_TYPE": ("Asset Type", "#6b5600"),
    "COMMUNICATION_MODALITY": ("Communication Modality", "#7b4d93"),
    "CURRENCY": ("Currency", "#7a5a00"),
    "DATA_FORMAT": ("Data Format", "#4a5568"),
    "DOCUMENT_ARTIFACT": ("Document / Artifact", "#9c4a10"),
    "DOCUMENT_METADATA": ("Document Metadata", "#8b5e3c"),
    "ENGAGEMENT_TERMS": ("Engagement Terms", "#10613a"),
    "EVENT": ("Event", "#b91c1c"),
    "FINANCIAL_CONCEPTS": ("Financial Concepts and Metrics", "#6e4b00"),
    "FORUMS_VENUES": ("Forums and Venues", "#7b2d8e"),
    "GOVERNMENTAL_BODY": ("Governmental Body", "#1a6091"),
    "INDUSTRY": ("Industry", "#065550"),
    "LANGUAGE": ("Language", "#7a3b10"),
    "LEGAL_AUTHORITIES": ("Legal Authorities", "#8b1a1a"),
    "LEGAL_ENTITY": ("Legal Entity", "#085e40"),
    "LEGAL_USE_CASES": ("Legal Use Cases", "#4a3570"),
    "LOCATION": ("Location", "#105560"),
    "MATTER_NARRATIVE": ("Matter Narrative", "#6d3580"),
    "MATTER_NARRATIVE_FORMAT": ("Matter Narrative Format", "#1a6894"),
    "OBJECTIVES": ("Objectives", "#b03020"),
    "SERVICE": ("Service", "#065e4e"),
    "STANDARDS_COMPATIBILITY": ("Standards Compatibility", "#4a5a6a"),
    "STATUS": ("Status", "#864a08"),
    "SYSTEM_IDENTIFIERS": ("System Identifiers", "#3d4d5a"),
}

#: The colour of a branch that isn't among them.
FALLBACK_COLOR = "#4a5568"

#: Branches left out of matching; an ontology's own type branch is passed in beside them.
EXCLUDED_BRANCHES = ("Standards Compatibility", "ZZZ - SANDBOX: UNDER CONSTRUCTION", "Area of Law")

#: A branch that stands for others.
VIRTUAL_BRANCHES = {"Document Metadata": ("Actor / Player", "Document / Artifact")}

#: Labels that are no patterns.
PATTERN_STOP = [
    "a", "an", "the", "to", "of", "in", "on", "at", "by", "for", "or", "and", "is", "it", "be", "as", "do", "no", "so", "up", "if", "my", "me", "he", "we", "am", "us", "go", "re",
    "al", "de", "la", "le", "mr", "ms", "dr", "st", "vs", "id", "ie", "eg", "etc", "per", "via", "not", "but", "has", "had", "was", "are", "its", "may", "can", "did", "she",
    "his", "her", "him", "our", "who", "how", "all", "any", "new", "one", "two", "out", "own", "set", "use", "way", "day", "get", "see", "now", "old", "end", "put", "run", "let",
    "say", "too", "yet", "off", "try", "ask", "got", "met", "cut", "pay", "due", "add",
]

#: One-word alternative labels that are common words.
ALTERNATIVE_STOP = [
    "act", "bar", "bill", "bond", "brief", "case", "charge", "claim", "code", "count", "court", "deed", "due", "duty", "fee", "fine", "firm", "fund", "grant", "hold", "law",
    "lien", "loan", "loss", "note", "order", "party", "pay", "plea", "right", "rule", "sale", "seal", "suit", "tax", "term", "title", "tort", "trust", "use", "wage", "ward",
    "will", "writ",
]

#: Property labels that are no patterns.
PROPERTY_STOP = ("not", "and", "near", "equal", "can", "has", "or")

#: Words that searches pass over.
SEARCH_STOP = [
    "a", "an", "the", "of", "and", "or", "in", "for", "to", "with", "by", "on", "at", "is", "are", "was", "were", "be", "been", "being", "not", "no", "has", "have", "had", "do",
    "does", "did", "this", "that", "it", "its", "their", "other", "such", "than", "law", "legal", "type", "types", "general",
]

#: Words that a query's word also stands for.
EXPANSIONS = {
    "litigation": ["practice", "service"],
    "transactional": ["practice", "service"],
    "transaction": ["practice", "service"],
    "transactions": ["practice", "service"],
    "regulatory": ["practice", "compliance"],
    "compliance": ["practice", "service"],
    "advisory": ["practice", "service"],
    "dispute": ["service", "resolution"],
    "disputes": ["service", "resolution"],
    "mediation": ["service"],
    "arbitration": ["service"],
    "negotiation": ["service"],
    "settlement": ["service", "practice"],
    "appellate": ["practice", "service"],
    "trial": ["practice", "service"],
    "appeals": ["practice", "service"],
    "prosecution": ["service"],
    "enforcement": ["service", "action"],
    "investigation": ["service"],
    "corporate": ["practice", "service", "law"],
    "employment": ["practice", "service", "law"],
    "intellectual": ["property", "practice"],
    "bankruptcy": ["practice", "service", "law"],
    "family": ["practice", "law"],
    "immigration": ["practice", "service", "law"],
    "environmental": ["practice", "law", "compliance"],
    "antitrust": ["practice", "law", "compliance"],
    "tax": ["practice", "service", "law"],
    "real": ["estate", "property"],
    "estate": ["planning", "practice", "law"],
    "counsel": ["service", "practice"],
    "counseling": ["service", "practice"],
    "consulting": ["service", "practice"],
    "collection": ["service", "practice"],
    "recovery": ["service", "practice"],
    "foreclosure": ["service", "practice"],
    "discovery": ["service", "practice"],
    "diligence": ["service", "practice"],
    "audit": ["service", "practice"],
    "drafting": ["service", "practice"],
    "documentation": ["service", "practice"],
    "filing": ["service", "practice"],
    "strategy": ["service", "practice"],
    "planning": ["service", "practice"],
    "risk": ["service", "management"],
    "structuring": ["service", "practice"],
}

#: Fields that a span fills if one of the cues stands before it, in order.
FIELD_CUES = {
    "signatory": ["signature", "signed by", "executed by"],
    "court": ["in the", "united states district court", "court of"],
    "judge": ["honorable", "judge", "justice"],
    "attorney": ["attorney for", "counsel for", "represented by", "law offices of"],
    "witness": ["witness", "deponent", "affiant", "declarant"],
    "confidentiality": ["confidential", "under seal", "attorney-client", "privileged"],
}

#: Families of individuals by words of their class labels.
FAMILIES = {
    "Persons": ["person", "human", "individual"],
    "Organizations": ["organization", "company", "corporation", "firm", "entity"],
    "Courts": ["court", "tribunal"],
    "Dates": ["date", "time"],
    "Addresses": ["address", "location", "place"],
    "Monetary": ["money", "monetary", "amount", "currency"],
}

#: Words that, alone, make no phrase worth a semantic search, beside those that are no patterns.
PHRASE_STOP = [
    "this", "that", "they", "them", "what", "when", "where", "which", "whom", "each", "some", "such", "both", "same", "said", "here", "have", "been", "were", "will", "does", "done", "made", "shall", "being",
    "with", "from", "into", "than", "then", "also", "just", "even", "more", "most", "only", "over", "very", "well", "much", "back", "like", "upon", "thus", "once",
]

#: Types of documents that can be asked for, by field.
DOCUMENT_TYPES = {
    "Litigation": ["Motion to Dismiss", "Complaint", "Answer", "Motion for Summary Judgment", "Memorandum of Law", "Court Opinion"],
    "Contracts": ["Commercial Lease", "Employment Agreement", "NDA", "Purchase Agreement", "Service Agreement"],
    "Corporate": ["Board Resolution", "Bylaws Amendment", "Shareholder Agreement", "Operating Agreement"],
    "Regulatory": ["Compliance Report", "Regulatory Filing", "Agency Opinion"],
    "Law Firm Operations": ["Engagement Letter", "Legal Opinion Letter"],
    "Real Estate": ["Deed of Trust", "Purchase and Sale Agreement", "Lease Agreement"],
    "IP": ["Patent License Agreement", "Trademark Assignment"],
    "Estate Planning": ["Last Will and Testament", "Trust Agreement"],
    "Immigration": ["Immigration Petition", "Visa Application Support Letter"],
}

#: Tasks that models are asked for.
MODEL_TASKS = ["classifier", "extractor", "concept", "branch_judge", "area_of_law", "synthetic", "individual", "property", "document_type"]

#: Abbreviations of legal and general English that are known before any text is read, without their last period.
ABBREVIATIONS = [
    *["adm", "admin", "aff'd", "al", "ann", "app", "art", "ass'n", "assn", "aug", "ave", "bankr", "bldg", "blvd", "bros", "ca", "cert", "cf", "ch", "cir", "civ", "cl", "co", "comm", "comm'n", "conf", "cong", "const", "corp", "crim", "ct"],
    *["dec", "def", "dep't", "dept", "dist", "div", "dr", "ed", "eds", "esq", "etc", "evid", "ex", "exh", "feb", "fed", "fig", "gen", "gov", "gov't", "hon", "id", "inc", "int'l", "jan", "jr", "jul", "jun", "ltd", "mar", "mem", "messrs"],
    *["mr", "mrs", "ms", "nat'l", "no", "nos", "nov", "oct", "op", "ord", "para", "pet", "pl", "pp", "proc", "prof", "pub", "reg", "rel", "rev", "rptr", "sec", "sen", "sep", "sept", "sr", "st", "stat", "super", "supp", "treas", "univ", "v", "vol", "vs"],
]

#: The fields that a model is asked for of a document, and whether each is a list.
METADATA_FIELDS = {
    "case_name": False, "court": False, "judge": False, "case_number": False, "parties": True, "jurisdiction": False, "procedural_posture": False, "cause_of_action": False, "claim_types": True,
    "relief_sought": False, "disposition": False, "standard_of_review": False, "governing_law": False, "author": False, "recipient": False, "attorneys": True, "signatories": True, "witnesses": True,
    "date_filed": False, "date_signed": False, "date_effective": False, "date_due": False, "dates_mentioned": True, "document_title": False, "docket_entry_number": False, "related_documents": True, "confidentiality": False,
    "contract_type": False, "counterparties": True, "term_duration": False, "termination_conditions": False, "consideration": False, "language": False, "addresses": True, "has_exhibits": False, "exhibit_list": True,
}
