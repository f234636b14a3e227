"""Vocabulary of the knowledge graph.

Fixed values below must equal the source system's for the same results: class
names, the class hierarchy, class labels, predicate local names, graph names and
the default field-unification rules. They are stated plainly and kept together.
Our namespace is neutral.
"""

from __future__ import annotations

NS = "http://example.org/kg#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
RDFS_SUBCLASS = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
OWL_SAMEAS = "http://www.w3.org/2002/07/owl#sameAs"


def p(local: str) -> str:
    return NS + local


# ---- fixed values: predicate local names --------------------------------------------
TITLE = p("title")
LINK = p("link")
CONTENT = p("content")
EMAIL = p("email")
AUTHOR = p("author")
ANCESTOR = p("ancestor")
REFLEXIVE = p("reflexive")
CREATION_TIME = p("creationTime")
LAST_UPDATE_TIME = p("lastUpdateTime")
REFERENCE = p("reference")

# ---- fixed values: named graphs -------------------------------------------------------
GRAPH_KNOWLEDGE = "knowledge"
GRAPH_ONTOLOGY = "ontology"
GRAPH_CONTENT = "content"
GRAPH_REFERENCE = "reference"
GRAPHS = (GRAPH_KNOWLEDGE, GRAPH_ONTOLOGY, GRAPH_CONTENT, GRAPH_REFERENCE)

# ---- fixed values: classes, hierarchy (sub, super) and labels (class, text, lang) -----
CLASSES = (
    "Channel", "Commentary", "ConfluenceContent", "Page", "Person",
    "Post", "Space", "Team", "TeamsContent",
)
CLASS_EDGES = (
    ("Channel", "TeamsContent"),
    ("Commentary", "ConfluenceContent"),
    ("Page", "ConfluenceContent"),
    ("Post", "TeamsContent"),
    ("Space", "ConfluenceContent"),
    ("Team", "TeamsContent"),
)
CLASS_LABELS = (
    ("Channel", "Channel", "en"),
    ("Channel", "Kanal", "de"),
    ("Commentary", "Commentary", "en"),
    ("Commentary", "Kommentar", "de"),
    ("Page", "Page", "en"),
    ("Page", "Seite", "de"),
    ("Person", "Person", "en"),
    ("Post", "Beitrag", "de"),
    ("Post", "Post", "en"),
    ("Space", "Space", "en"),
    ("Team", "Team", "en"),
)
# property axioms (property local name, kind, argument)
PROPERTY_AXIOMS = (
    ("ancestor", "asymmetric", None),
    ("ancestor", "irreflexive", None),
    ("author", "functional", None),
    ("author", "asymmetric", None),
    ("author", "irreflexive", None),
    ("reference", "asymmetric", None),
    ("reference", "irreflexive", None),
    ("content", "range", "http://www.w3.org/2001/XMLSchema#string"),
    ("creationTime", "range", "http://www.w3.org/2001/XMLSchema#dateTime"),
    ("lastUpdateTime", "range", "http://www.w3.org/2001/XMLSchema#dateTime"),
    ("link", "range", "http://www.w3.org/2001/XMLSchema#anyURI"),
    ("title", "range", "http://www.w3.org/2001/XMLSchema#string"),
)

# ---- fixed values: default field-unification rules (unified name -> candidate paths) --
FIELD_RULES = {
    "_id": ["_id"],
    "type": ["type", "messageType"],
    "name": ["name", "displayName"],
    "email": ["email", "mail"],
    "title": ["title", "subject"],
    "link": ["_links.webui", "personalSpace._links.webui", "webUrl"],
    "content": ["body.view.value", "body.content", "description"],
    "author": ["history.createdBy.displayName", "from.user.displayName"],
    "creationTime": ["history.createdDate", "createdDateTime"],
    "lastUpdateTime": ["history.lastUpdated.when", "lastEditedDateTime"],
    "ancestor": ["ancestor", "teamId", "pageId", "postId", "channelIdentity.channelId"],
}
UNIFIED_FIELDS = tuple(FIELD_RULES)

# ---- fixed values: search weights and presentation -------------------------------------
REF_WEIGHT = 2.5
PARENT_WEIGHT = 0.5
CHILD_WEIGHT = 0.5
BM25_K1 = 1.2
BM25_B = 0.75
PAGE_SIZE = 10
SNIPPET_CHARS = 300
SNIPPET_BLOCKS = 7
UNTITLED_POST = "MS Teams Message"
TYPES_SEPARATOR = ", "
ANCESTOR_SEPARATOR = "///"
BREADCRUMB_SEPARATOR = " / "
BLOCK_SEPARATOR = " · "
