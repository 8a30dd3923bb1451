"""The keyword lists that describe periods, domains, regions and venue types.

`*_REF` lists follow the wording of the catalogues, the others the wording of conversations.
The order of the categories is the order of every report.
"""

from __future__ import annotations

PERIODS_REF = {
    "Moyen Âge": [
        "5e siècle", "6e siècle", "7e siècle", "8e siècle", "9e siècle", "10e siècle",
        "11e siècle", "12e siècle", "13e siècle", "14e siècle", "15e siècle", "médiéval",
        "gothique", "roman",
    ],
    "Renaissance": ["16e siècle", "renaissance", "maniérisme"],
    "XVIIe siècle": ["17e siècle", "baroque"],
    "XVIIIe siècle": ["18e siècle", "rococo", "néoclassique"],
    "XIXe siècle": [
        "19e siècle", "romantisme", "impressionnisme", "réalisme", "naturalisme", "symbolisme",
        "art nouveau",
    ],
    "XXe siècle": [
        "20e siècle", "cubisme", "surréalisme", "abstrait", "fauvisme", "expressionnisme",
        "dadaïsme", "bauhaus",
    ],
    "Art contemporain": ["21e siècle", "contemporain"],
}

PERIODS = {
    "Moyen Âge": [
        "médiéval", "médiévale", "médiévaux", "gothique", "moyen-âge", "moyen âge",
        "roman art", "féodal", "moyen age", "xe siècle", "xie siècle", "xiie siècle",
        "xiiie siècle", "xive siècle", "xve siècle",
    ],
    "Renaissance": [
        "renaissance", "xvie siècle", "humanisme", "maniérisme", "quattrocento",
        "cinquecento", "16e siècle",
    ],
    "XVIIe siècle": [
        "xviie siècle", "baroque", "classicisme", "17e siècle", "grand siècle", "louis xiv",
    ],
    "XVIIIe siècle": [
        "xviiie siècle", "rococo", "lumières", "18e siècle", "néoclassique", "louis xv",
        "louis xvi",
    ],
    "XIXe siècle": [
        "xixe siècle", "romantisme", "romantique", "impressionnisme", "impressionniste",
        "réalisme", "naturalisme", "symbolisme", "19e siècle", "art nouveau",
    ],
    "XXe siècle": [
        "xxe siècle", "cubisme", "cubiste", "surréalisme", "surréaliste", "abstrait",
        "abstraction", "dadaïsme", "fauvisme", "expressionnisme", "20e siècle", "art moderne",
        "bauhaus",
    ],
    "Art contemporain": [
        "art contemporain", "xxie siècle", "installation artistique", "art numérique",
        "performance artistique", "21e siècle", "street art", "land art",
    ],
}

DOMAINS = {
    "Peinture": [
        "peinture", "tableau", "huile sur toile", "toile peinte", "portrait peint",
        "aquarelle", "fresque", "peintre", "peindre",
    ],
    "Sculpture": [
        "sculpture", "sculpteur", "statue", "bas-relief", "bronze sculptural",
        "marbre sculpté", "taille de pierre",
    ],
    "Arts décoratifs": [
        "arts décoratifs", "tapisserie", "céramique", "orfèvrerie", "faïence",
        "mobilier ancien", "ébénisterie", "vitrail",
    ],
    "Dessin": [
        "dessin", "esquisse", "crayon", "pastel", "gouache", "lavis", "croquis",
        "dessinateur",
    ],
    "Photographie": [
        "photographie", "photographe", "cliché photographique", "tirage argentique",
        "daguerréotype", "argentique",
    ],
    "Arts graphiques": [
        "gravure", "estampe", "lithographie", "sérigraphie", "xylographie", "taille-douce",
        "eau-forte",
    ],
    "Archéologie": [
        "archéologie", "archéologique", "fouille", "antiquité", "gallo-romain",
        "préhistoire", "mérovingien", "néolithique", "paléolithique", "site archéologique",
    ],
}

REGIONS = {
    "Île-de-France": [
        "paris", "versailles", "louvre", "île-de-france", "saint-denis", "vincennes",
        "fontainebleau",
    ],
    "Auvergne-Rhône-Alpes": [
        "lyon", "grenoble", "clermont-ferrand", "auvergne", "rhône-alpes", "annecy",
        "chambéry", "saint-étienne",
    ],
    "Occitanie": [
        "toulouse", "montpellier", "occitanie", "languedoc", "nîmes", "perpignan",
        "carcassonne", "albi",
    ],
    "Nouvelle-Aquitaine": [
        "bordeaux", "limoges", "poitiers", "nouvelle-aquitaine", "périgueux", "biarritz",
        "bayonne", "angoulême",
    ],
    "Grand Est": [
        "strasbourg", "reims", "nancy", "alsace", "lorraine", "champagne", "metz",
        "mulhouse", "colmar",
    ],
    "Hauts-de-France": [
        "lille", "amiens", "valenciennes", "picardie", "hauts-de-france", "boulogne",
        "dunkerque", "arras",
    ],
    "Bretagne": ["rennes", "brest", "bretagne", "quimper", "saint-malo", "lorient", "vannes"],
    "Normandie": [
        "rouen", "caen", "normandie", "cherbourg", "le havre", "bayeux", "mont-saint-michel",
    ],
    "Pays de la Loire": [
        "angers", "le mans", "pays de la loire", "nantes", "saint-nazaire",
        "la roche-sur-yon",
    ],
    "Provence-Alpes-Côte d'Azur": [
        "marseille", "nice", "avignon", "provence", "toulon", "aix-en-provence", "cannes",
        "antibes",
    ],
    "Centre-Val de Loire": [
        "tours", "orléans", "blois", "val de loire", "bourges", "châteauroux", "amboise",
        "chenonceau",
    ],
    "Bourgogne-Franche-Comté": [
        "dijon", "besançon", "bourgogne", "franche-comté", "auxerre", "chalon-sur-saône",
        "mâcon",
    ],
    "Corse": ["ajaccio", "bastia", "corse", "bonifacio", "corte"],
}

TYPES_REF = {
    "Musées": ["musée"],
    "Bibliothèques": ["bibliothèque", "librairie"],
    "Théâtres & Opéras": ["théâtre", "opéra", "scène"],
    "Cinémas": ["cinéma"],
    "Centres culturels & art": [
        "centre culturel", "centre d'art", "centre de création artistique",
        "centre de création musicale", "conservatoire",
    ],
    "Archives": ["service d'archives"],
    "Monuments & lieux": [
        "monument", "lieu archéologique", "lieu de mémoire", "espace protégé",
        "parc et jardin",
    ],
}

TYPES = {
    "Musées": ["musée", "galerie d'art", "beaux-arts", "pinacothèque"],
    "Bibliothèques": ["bibliothèque", "médiathèque", "lecture publique", "librairie"],
    "Théâtres & Opéras": [
        "théâtre", "opéra", "scène nationale", "spectacle vivant", "comédie-française",
        "cirque",
    ],
    "Cinémas": ["cinéma", "cinémathèque", "festival de cinéma", "ciné-club"],
    "Centres culturels & art": [
        "centre culturel", "centre d'art", "maison de la culture", "conservatoire",
        "école des beaux-arts", "micro-folie",
    ],
    "Archives": [
        "archives nationales", "archives départementales", "service d'archives",
        "fonds d'archives",
    ],
    "Monuments & lieux": [
        "monument historique", "château", "cathédrale", "abbaye", "lieu de mémoire",
        "site archéologique", "dolmen", "parc naturel", "jardin historique",
    ],
}

# End of the fixed values.

Dictionary = dict[str, list[str]]
DictionarySet = dict[str, Dictionary]

#: What is counted in the texts of the models.
CONVERSATION_SIDE: DictionarySet = {
    "periods": PERIODS, "domains": DOMAINS, "regions": REGIONS, "types": TYPES,
}
#: What is counted in the catalogues.
CATALOGUE_SIDE: DictionarySet = {
    "periods": PERIODS_REF, "domains": DOMAINS, "regions": REGIONS, "types": TYPES_REF,
}


def dictionary_rows(dictionaries: DictionarySet) -> list[tuple[str, str, str, int]]:
    """(dict, category, keyword, rank of the category) for a set of dictionaries."""
    return [
        (name, category, keyword, rank)
        for name, categories in dictionaries.items()
        for rank, (category, keywords) in enumerate(categories.items())
        for keyword in keywords
    ]


def keyword_set(dictionaries: DictionarySet = CONVERSATION_SIDE) -> list[str]:
    """Every keyword of the dictionaries once, sorted."""
    return sorted({row[2] for row in dictionary_rows(dictionaries)})
