"""factloom: facts, graphs and coverage over corpora of specification text, as Spark jobs."""
