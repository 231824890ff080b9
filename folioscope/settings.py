"""Limits that decide results, and limits that only decide how work is spread."""

# Part of the results.
PREP_VERSION = 3
MIN_COLUMN_GAP = 40
MAX_TEXT_CHARS = 20000
MAX_VIEW_SIDE = 12000
GROUP_MAX_HEIGHT = 520
GROUP_MAX_LINES = 8
SEARCH_MAX = 20
SEARCH_DEFAULT = 8
MAX_FORMS = 40
MIN_FORM_COUNT = 3
MIN_NEIGHBOUR_SCORE = 0.55
MAX_NEIGHBOURS = 4
MIN_GAP_QUERY_CHARS = 8
NEIGHBOUR_CHARS = 400
VECTOR_SIZE = 768
EMBED_BATCH = 16
REDETECT_OVERLAP = 0.4
SNIPPET_CHARS = 180
SNIPPET_LEAD = 56
MAX_NAME_CHARS = 180
DEFAULT_SENSITIVITY = 0.55

# Spreading of work: any value gives the same rows.
QUERY_BLOCK = 8_192           # query vectors per block of a similarity join (25 MB at 768 floats; short vectors up to the same size)
VECTOR_BLOCK = 32_768         # stored vectors per block of a similarity join (100 MB at 768 floats; short vectors up to the same size)
QUERY_ROWS = 8_192            # query vectors unpacked at a time inside a task
HEAD_DIMS = 128               # dimensions a folded vector keeps as they are
TAIL_DIMS = 128               # groups of the other dimensions, of which it keeps norms
FOLD_SHARE = 0.1              # folded vectors are given up where they leave more of the pairs
CROWDED = 64                  # rows of SCORE_BLOCK a query may have scored one by one
SCORE_BLOCK = 1_024           # stored vectors scored at a time inside a task
LIST_BLOCK = 8_192            # rows of one dimension's list multiplied at a time in a threshold join
