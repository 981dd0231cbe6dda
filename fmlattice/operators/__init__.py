"""DataFrame operators: fields, dictionaries, vectorizer, side tables, data
sets, model scoring, and the coordinate-descent learner."""
