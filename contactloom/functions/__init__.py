"""Column expressions: text, URLs, phone numbers, e-mail addresses, links, ordered folds; and the HTML reader."""
