"""Training-data operators: each module is one operator with a general
interface; ``queries`` derives the registered digest queries from them."""
