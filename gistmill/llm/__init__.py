"""Training-data operators: search, deduplication, decontamination, filtering, archives, formatting and tokenising.

Nothing outside this folder imports it.  Each module holds one operator with a general interface; ``queries`` registers
one thin query per operator and ``oracles`` the SQL that states the same result where SQL can.
"""
