"""Feature scaling, classifiers and anomaly detectors."""
