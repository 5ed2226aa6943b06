"""Domain recodes of the curated layer, as composed maps (source -> final).

Fixed values: each map is the composition of the edition's sequential
whole-word, case-insensitive replace rules for that column; placeholder
letters used inside a chain are kept as accepted inputs.  Keys are
upper-case tokens; values not listed pass unchanged.
"""

ALL_YEARS = (2015, 2016, 2017, 2018, 2019)


def _map(text: str) -> dict[str, str]:
    out = {}
    for item in text.split():
        src, dst = item.split("->")
        out[src] = dst
    return out


# (column, editions, map)
_RECODES = [
    ("ANO_CCL_ENS_MED", (2015, 2016), _map(
        "0->0 10->1 9->2 8->3 7->4 6->5 5->6 4->7 3->8 2->9 1->10 "
        "A->1 B->2 C->3 D->4 E->5 F->6 G->7 H->8 I->9 J->10")),
    ("ANO_CCL_ENS_MED", (2017, 2018), _map(
        "0->0 12->1 11->2 10->3 9->4 8->5 7->6 6->7 5->8 4->9 3->10 2->11 1->12 "
        "A->1 B->2 C->3 D->4 E->5 F->6 G->7 H->8 I->9 J->10 K->11 L->12")),
    ("ANO_CCL_ENS_MED", (2019,), _map(
        "0->0 13->1 12->2 11->3 10->4 9->5 8->6 7->7 6->8 5->9 4->10 3->11 2->12 1->13 "
        "A->1 B->2 C->3 D->4 E->5 F->6 G->7 H->8 I->9 J->10 K->11 L->12 M->13")),
    ("COD_EST_CVL", (2015, 2016, 2017, 2018), _map("3->4 2->3 1->2 0->1")),
    ("COD_SEX", ALL_YEARS, _map("F->0 M->1")),
    ("COD_SIT_RDC", (2015,), _map(
        "2->0 5->0 98->0 4->1 1->3 3->4 7->5 8->6 6->7 9->8 A->0 B->1 C->3 D->4 E->5 F->6 G->7 H->8")),
    ("COD_SIT_RDC", (2016,), _map(
        "2->0 5->0 4->1 1->3 3->4 7->5 8->6 6->7 9->8 A->0 B->1 C->3 D->4 E->5 F->6 G->7 H->8")),
    ("COD_SIT_RDC", (2017, 2018, 2019), _map(
        "2->0 4->1 1->3 3->4 7->5 8->6 6->7 9->8 A->0 B->1 C->3 D->4 E->5 F->6 G->7 H->8")),
    ("Q001", ALL_YEARS, _map("H->0 A->1 C->2 B->3 D->5 E->7 F->8 G->9")),
    ("Q002", (2015, 2016, 2017, 2018), _map("H->0 A->1 C->2 B->3 D->5 E->7 F->8 G->9")),
    ("Q002", (2019,), _map("H->0 A->1 C->2 B->3 D->5 E->6 F->7 G->8")),
    ("Q003", ALL_YEARS, _map("F->0 A->1 B->2 C->3 D->4 E->5")),
    ("Q004", ALL_YEARS, _map("F->0 A->1 B->2 C->3 D->4 E->5")),
    ("Q006", ALL_YEARS, _map(
        "A->0 B->1 C->3 D->4 E->5 F->6 G->8 H->10 I->11 J->13 K->15 L->17 M->18 N->20 O->21 P->22 Q->22")),
    ("Q007", (2015, 2016), _map("A->0 B->1 C->1")),
    ("Q008", (2015,), _map("A->1 B->2 C->2 D->3 E->3 F->4 G->4 H->4 I->4 J->4 K->4 L->4 M->4")),
    ("Q008", (2016,), _map("A->1 B->2 C->2 D->2 E->3 F->3 G->4 H->4 I->4 J->4 K->4 L->4 M->4")),
    ("Q009", (2015, 2016), _map("A->0 B->1 C->2 D->3 E->4")),
    ("Q013", ALL_YEARS, _map(
        "1->1 2->1 3->1 4->2 5->2 6->2 7->2 8->3 9->3 10->3 11->4 12->4 13->4 14->4 15->4 16->4 17->4 "
        "18->4 19->4 20->4")),
    ("Q014", ALL_YEARS, _map("A->0 B->1")),
    ("Q015", ALL_YEARS, _map("A->0 B->1")),
    ("Q016", ALL_YEARS, _map("A->0 B->1 C->1 D->1 E->1")),
    ("Q017", ALL_YEARS, _map("A->0 B->1 C->1 D->1 E->1")),
    ("Q018", ALL_YEARS, _map("A->0 B->1 C->1 D->1 E->1")),
    ("Q019", ALL_YEARS, _map("A->0 B->1 C->1 D->1 E->1")),
    ("Q020", ALL_YEARS, _map("A->0 B->1 C->1 D->1 E->1")),
    ("Q021", ALL_YEARS, _map("A->0 B->1 C->1 D->1 E->1")),
    ("Q022", ALL_YEARS, _map("A->0 B->1 C->1 D->1 E->1")),
    ("Q023", ALL_YEARS, _map("A->0 B->1 C->1 D->1 E->1")),
    ("Q024", ALL_YEARS, _map("A->0 B->1 C->1 D->1 E->1")),
    ("Q025", ALL_YEARS, _map("A->0 B->1 C->1 D->1 E->1")),
    ("Q026", ALL_YEARS, _map("A->0 B->1 C->1 D->1 E->1")),
    ("Q028", ALL_YEARS, _map("A->0 B->1 C->1 D->1 E->1")),
    ("Q029", ALL_YEARS, _map("A->0 B->1")),
    ("Q030", ALL_YEARS, _map("A->0 B->1 C->1 D->1 E->1")),
    ("Q031", ALL_YEARS, _map("A->0 B->1")),
    ("Q032", ALL_YEARS, _map("A->0 B->1")),
    ("Q033", ALL_YEARS, _map("A->0 B->1 C->1 D->1")),
    ("Q034", (2015, 2016), _map("A->0 B->1 C->1 D->1")),
    ("Q036", (2015, 2016, 2017, 2018), _map("D->0 A->1 B->2 C->3")),
    ("Q037", (2015, 2016), _map("A->0 B->1 C->1 D->1")),
    ("SIT_CCL_ENS_MED", (2015, 2016), _map("4->0 1->1 3->2 2->3 A->2 B->3")),
    ("SIT_CCL_ENS_MED", (2017, 2018, 2019), _map("4->0 1->1 2->2 3->3 A->2 B->3")),
    ("TPO_ENS_ESC_ENS_FDM_DET", (2015, 2016), _map("A->0 B->1 C->2 D->3")),
    ("TPO_ENS_ESC_ENS_MED", ALL_YEARS, _map("1->0 3->2 2->3 A->2 B->3")),
    ("TPO_ENS_ESC_ENS_MED_DET", (2015, 2016), _map("A->0 B->1 C->2 D->3")),
    ("TPO_ESC_ENS_FDM_DET", (2015, 2016), _map("E->1 G->2 A->3 C->4 F->5 H->6 B->7 D->8")),
    ("TPO_ESC_ENS_MED", ALL_YEARS, _map("1->0 2->1 3->2 4->3")),
    ("TPO_ESC_ENS_MED_DET", (2015, 2016, 2017, 2018), _map("A->0 D->2 E->2 B->5 C->5 F->7")),
    ("TPO_LNG_ESTG", ALL_YEARS, _map("1->0 0->1 A->0 B->1")),
    ("TRN_ENS_FDM", (2015, 2016), _map("A->0 B->1 C->2")),
    ("TRN_ENS_MED", (2015, 2016), _map("A->0 B->1 C->2")),
]


def recodes_for(year: int) -> dict[str, dict[str, str]]:
    """Column -> composed map for one edition."""
    return {col: m for col, years, m in _RECODES if year in years}
