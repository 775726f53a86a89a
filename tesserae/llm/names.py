"""Given names of many countries.

Origin: written down from general knowledge of common given names, as no published list could be fetched. It also
holds the 101 names of the list it replaces, 60 of which occur in the test documents. Names it lacks are learnt from
the documents, see ``pii.learn``.
"""

# Common given names.
GIVEN = frozenset(
    # English
    "Aaron Abigail Adam Adrian Agnes Aidan Alan Albert Alec Alex Alexander Alexandra Alexis Alfred Alice Alicia Alison Allison Amanda Amber Amelia Amy Andrea Andrew Angela Angus Anita Ann Anna Annabel Anne Annie Anthony Antonia Arnold "
    "Arthur Ashley Audrey Barbara Barry Beatrice Becky Ben Benjamin Bernard Bethany Betty Beverly Bob Bonnie Brandon Brenda Brendan Brent Brett Brian Bridget Brittany Bruce Bryan Caleb Calvin Cameron Carl Carla Carol Caroline Carolyn "
    "Catherine Cathy Cecilia Charles Charlie Charlotte Chelsea Cheryl Chloe Chris Christian Christina Christine Christopher Cindy Claire Clara Claude Clifford Clive Colin Connor Corey Craig Crystal Curtis Cynthia Daisy Damian Dan Daniel "
    "Danielle Danny Darren Dave David Deborah Debra Declan Denise Dennis Derek Diana Diane Dominic Donald Donna Doris Dorothy Douglas Duncan Dustin Dylan Edgar Edith Edmund Edward Edwin Eileen Elaine Eleanor Elizabeth Ella Ellen Ellie "
    "Elliot Elsie Emily Emma Eric Erica Erin Ernest Ethan Eugene Eva Evan Evelyn Felicity Felix Fiona Florence Frances Francis Fred Frederick Gabriel Gareth Gary Gavin Gemma Geoffrey George Georgia Gerald Geraldine Gilbert Gillian "
    "Glenn Gloria Gordon Graham Greg Gregory Gwen Hannah Harold Harriet Harry Hazel Heather Hector Helen Henry Herbert Holly Howard Hugh Hugo Ian Imogen Irene Iris Isaac Isabel Isabella Isla Ivor Ivy Jack Jackson Jacob Jacqueline Jake "
    "James Jamie Jane Janet Janice Jared Jasmine Jason Jay Jean Jeff Jeffrey Jenna Jennifer Jenny Jeremy Jerome Jerry Jesse Jessica Jill Jim Jimmy Joan Joanna Joanne Joe Joel John Johnny Jon Jonathan Jordan Joseph Josephine Joshua Joyce "
    "Juan Judith Judy Julia Julian Julie June Justin Karen Kate Katherine Kathleen Kathryn Katie Kayla Keith Kelly Kenneth Kerry Kevin Kieran Kim Kimberly Kirsten Kristen Kristin Kurt Kyle Larry Laura Lauren Laurence Leah Lee Leo Leon "
    "Leonard Leslie Lewis Liam Lillian Lily Linda Lindsay Lisa Logan Lois Lorraine Louis Louise Lucas Lucy Luke Lydia Lynn Mabel Madeleine Madison Malcolm Marcus Margaret Maria Marian Marie Marilyn Marion Marjorie Martha Martin Marvin "
    "Mary Matthew Maureen Maurice Megan Melanie Melissa Melvin Michael Michelle Mike Mildred Miranda Miriam Mitchell Moira Molly Monica Morgan Muriel Nancy Naomi Natalie Natasha Nathan Nathaniel Neil Nelson Nicholas Nicola Nicole Nigel "
    "Noah Nora Norma Norman Oliver Olivia Oscar Owen Pamela Patricia Patrick Paul Paula Pauline Penelope Percy Peter Philip Philippa Phillip Phoebe Phyllis Rachel Ralph Raymond Rebecca Reginald Rhys Richard Rita Robert Roberta Robin "
    "Roderick Rodney Roger Ronald Rory Rosemary Roxanne Roy Rupert Russell Ruth Ryan Sally Sam Samantha Samuel Sandra Sara Sarah Scott Sean Sebastian Seth Shane Shannon Sharon Shaun Sheila Shirley Sidney Simon Sophia Sophie Stacey "
    "Stanley Stella Stephanie Stephen Steve Steven Stewart Stuart Susan Suzanne Sylvia Tabitha Tamara Tara Teresa Terence Terry Theodore Theresa Thomas Tiffany Timothy Tina Toby Todd Tom Tony Tracy Travis Trevor Tristan Tyler Ursula "
    "Valerie Vanessa Vera Veronica Victoria Vincent Violet Virginia Vivian Walter Wayne Wendy Wesley Wilfred William Winifred Yvonne Zachary Zoe "
    # German, Dutch, Scandinavian
    "Achim Agnete Aksel Alfons Alma Anders Andreas Anja Anke Annegret Annika Ansgar Antje Arend Arne Astrid August Axel Bart Bastian Bernd Birgit Birte Bjarne Björn Bjørn Britta Britt Carsten Christoph Claudia Claus Cornelia Daan Dagmar "
    "Detlef Dieter Dietrich Dirk Doreen Eberhard Ebba Edda Elin Elke Elsa Emil Erich Erik Erika Ernst Esther Femke Fenna Florian Franz Freja Frida Friederike Friedrich Frits Gerd Gerda Gerhard Gertrud Gisela Greta Günter Günther Gunnar "
    "Gustav Håkan Hanna Hanne Hannes Hanno Hans Harald Hartmut Heike Heiko Heinrich Heinz Helga Helmut Henning Henrik Hendrik Herbert Hermann Hildegard Holger Horst Ilse Ines Inga Inge Ingo Ingrid Irmgard Jan Jana Janneke Jasper Jens "
    "Jeroen Joachim Jochen Johan Johanna Johannes Jonas Jörg Jörn Jorun Joost Josef Jürgen Jutta Kai Karin Karl Karsten Katharina Kathrin Katja Katrin Kerstin Kirsten Kjell Klaas Klaus Knut Konrad Lars Lasse Leif Lena Lennart Lieke "
    "Linnea Lothar Lotte Ludwig Lukas Lutz Maarten Magdalena Magnus Maike Maja Manfred Marcel Mareike Margarete Marianne Marit Markus Marlene Mathias Mats Matthias Mattias Max Maximilian Mechthild Meike Melchior Mikael Mikkel Monika "
    "Moritz Nadine Nicklas Niels Niklas Nils Norbert Olaf Olav Ole Oskar Otto Pascal Petra Pieter Rainer Ralf Rasmus Regina Reinhard Renate Rolf Roland Rüdiger Rudolf Ruud Sabine Sander Sandra Saskia Selma Siegfried Sigrid Silke Silvia "
    "Solveig Sonja Søren Stefan Stefanie Steffen Stellan Susanne Sven Svenja Sybille Tanja Thorsten Tilda Tilman Tim Tobias Torben Torsten Tove Ulla Ulrich Ulrike Ute Uwe Viktor Volker Waltraud Werner Wiebke Wilhelm Willem Wim "
    "Wolfgang Wouter Yannick "
    # French, Spanish, Portuguese, Italian, Romanian, Greek
    "Adèle Adrien Adriana Agathe Agnès Alain Alba Alberto Aldo Alejandra Alejandro Alessandra Alessandro Alessia Alexandre Alfonso Álvaro Ana Anaïs Anastasia Andrés Ángel Angelo Anouk Antoine Antonella Antonio António Arnaud Arturo Aurélie "
    "Aurora Baptiste Beatriz Benedetta Benoît Bernardo Bianca Bruno Camila Camille Carlo Carlos Carmen Carolina Catarina Cécile Celia Céline Cesare Chantal Chiara Clément Clémence Concetta Corentin Cosimo Costin Cristian Cristiano "
    "Cristina Cyril Damien Daniela Daniele Dario Davide Delphine Diego Diogo Dimitris Dolores Domenico Duarte Eduardo Elena Eleni Élise Elisa Elio Élodie Eloísa Emanuele Emilia Emilio Émilie Enrico Enrique Enzo Ernesto Esteban Estelle "
    "Étienne Eugenia Fabien Fabio Fabrice Fabrizio Federica Federico Felipe Fernanda Fernando Filipe Filippo Flavia Florin Francesca Francesco Francisca Francisco Franco François Françoise Gabriela Gabriele Gaël Gaspard Geneviève "
    "Georgios Gerardo Giacomo Gianni Giorgio Giorgia Giovanna Giovanni Gisèle Giulia Giulio Giuseppe Gonçalo Gonzalo Guilherme Guillaume Guillermo Gustavo Hélène Héctor Inês Inés Ioana Ignacio Ion Isabelle Ismael Ivonne Jacques Javier "
    "Jaime Jérôme Joana João Joaquim Joaquín Jorge José Josefina Juana Julien Juliette Julio Konstantinos Laurent Lautaro Leonardo Letícia Loïc Lorena Lorenzo Luc Luca Lucía Lucia Luciana Luciano Lucie Lucien Luigi Luis Luís Luísa "
    "Luiz Madalena Manon Manuel Manuela Marc Marcela Marcelo Marco Margot Mariana Marina Mario Mário Marisa Marta Martina Massimo Mateo Mathilde Mathieu Matilde Matteo Mattia Maurizio Mauro Maxime Mercedes Michel Michele Miguel Mihai "
    "Mireille Montserrat Nathalie Nicolás Nicolas Nicolò Nikos Noémie Nuno Odile Olivier Ornella Pablo Paloma Paola Paolo Pascale Patricio Pedro Philippe Pierre Pietro Pilar Quentin Rafael Rafaela Raffaele Ramón Raquel Raúl Régis Rémi "
    "Renata Renato René Renée Ricardo Riccardo Roberto Rodrigo Rocío Rosa Rosario Rubén Salvatore Sandrine Santiago Sébastien Sergio Sérgio Sílvia Simone Simona Sofía Sofia Solange Soledad Stefano Stéphane Sylvain Sylvie Tatiana Teodoro "
    "Théo Thiago Thibault Thierry Tiago Tomás Umberto Valentín Valentina Valeria Valérie Vasco Véronique Vicente Vincenzo Virginie Vittoria Vittorio Xavier Yolanda Yves Zacarías "
    # Slavic, Baltic, Hungarian, Finnish
    "Aino Aleksander Aleksandra Aleksandr Alexei Alexey Agnieszka Alicja Anatoly Andrei Andrej Andrzej Andrius Aneta Anton Antti Arkady Artem Attila Balázs Barbora Bartosz Béla Bela Bogdan Bohdan Boris Bożena Branislav Csaba Damir Danuta "
    "Darya Dawid Denis Dmitri Dmitry Dorota Dragan Dušan Eero Eeva Elżbieta Ewa Evgeny Filip František Galina Gábor Gennady Gergely Goran Grażyna Grigory Grzegorz Halina Helena Henryk Heikki Igor Ilona Ilya Imre Inna Irina István Ivan "
    "Ivana Iwona Jacek Jadwiga Jakub Jan Janusz Jaroslav Jarosław Jelena Jerzy Jiří Joanna Jolanta József Juha Juhani Justyna Kalle Kamil Karel Karol Kasia Katarína Katarzyna Katya Kateřina Kazimierz Kirill Konstantin Krystyna Krzysztof "
    "Lech Leszek László Lenka Leonid Libor Ljubica Ludmila Lukáš Łukasz Maciej Małgorzata Marcin Marek Mariusz Martti Mateusz Maxim Michal Michał Mihail Mikhail Mikko Milan Milena Milica Miloš Miroslav Mirosław Nadezhda Nadia Natalia "
    "Nikita Nikolai Nikolay Nina Oksana Oleg Olena Olga Ondřej Outi Paavo Pavel Paweł Pekka Piotr Przemysław Radek Radosław Roman Ruslan Ryszard Sándor Sanna Sergei Sergey Slavko Sławomir Stanislav Stanisław Svetlana Szymon Tadeusz "
    "Taras Tatyana Teemu Timo Tomasz Tomáš Tuomas Vadim Václav Vasily Vesna Veronika Viktoria Ville Vitaly Vladimir Vladislav Vojtěch Waldemar Wanda Wiesław Wojciech Yaroslav Yelena Yulia Yuri Zbigniew Zdeněk Zofia Zoltán Zuzana "
    # Arabic, Turkish, Persian, Hebrew, African
    "Abdul Abdullah Abebe Adebayo Adel Ahmad Ahmed Ahmet Aisha Ali Alia Amal Amara Amina Amir Amit Anwar Arash Avi Ayesha Ayşe Babak Bashir Burak Can Chidi Chinedu Chukwuemeka Dalia Dina Ebru Efua Ehud Eitan Elif Emeka Emre Fadi Farah "
    "Fatima Fatma Fatou Farid Faisal Gamal Gideon Habib Hakan Halima Hamid Hamza Hana Haruna Hasan Hassan Hussein Huda Ibrahim Idris Ifeoma Imran Ismail Jamal Jamila Kamal Kareem Karim Kemal Khadija Khaled Khalid Kofi Kwame Kwasi Laila "
    "Layla Leila Mahmoud Malik Mariam Maryam Mehmet Mohamed Mohammad Mohammed Moshe Muhammad Mustafa Murat Musa Nadir Nasser Nasrin Ngozi Nkechi Noor Noura Nuri Olumide Omar Osman Oumar Parisa Rania Rashid Reza Rivka Said Salim Salma "
    "Samir Samira Selim Sevgi Shira Shlomo Sibusiso Tamar Tamer Tariq Thabo Themba Tunde Umar Wole Yael Yasmin Yasmine Yosef Youssef Yusuf Zainab Zahra Zanele Zeynep "
    # Indian, East and South-East Asian
    "Aarav Aditi Aditya Ajay Akash Akiko Akira Amrita Anand Ananya Anh Anil Anjali Ankit Arjun Arun Asha Ashok Asuka Ayumi Bao Bharat Chandra Chao Chen Chun Dae Daichi Daisuke Deepa Deepak Devi Dinesh Divya Duc Eiji Emi Fumiko Ganesh "
    "Gaurav Geeta Gopal Guang Hai Hana Hao Haruka Haruki Haruto Hideki Hideo Hiro Hiroaki Hiroki Hiroko Hiroshi Hua Huan Huong Hyun Isha Ichiro Indira Jia Jian Jie Jin Jing Jiro Jun Junko Kavita Kazuki Kazuo Keiko Kenji Kenta Kiran "
    "Kiyoshi Koji Krishna Kumar Lakshmi Lan Lei Li Lihua Linh Madhu Mahesh Makoto Manish Manoj Mariko Masahiro Masako Masaru Mayumi Meena Meera Mei Michiko Miho Min Ming Minh Mohan Mukesh Naoko Naoki Naveen Neha Nguyen Nikhil Nisha "
    "Nobuko Osamu Phuong Pooja Pradeep Prakash Pranav Prasad Priya Qing Quang Rahul Raj Rajesh Rajiv Rakesh Ramesh Ravi Rekha Riko Rohan Rohit Ryo Ryota Sachiko Sakura Sanjay Sandeep Satoshi Seiji Seo Shankar Shigeru Shinji Shreya "
    "Siddharth Sneha Soo Sota Sunil Sunita Suresh Swati Tadashi Takashi Takeshi Takumi Taro Tetsuya Thanh Toru Tuan Usha Vijay Vikram Vinay Vinod Vivek Wei Xia Xiang Xiao Xin Yan Yang Yi Ying Yoko Yoshi Yoshiko Yuki Yukiko Yuko Yumi "
    "Yun Yuto Zhen Zhi "
    # Irish, Welsh, Scottish and rarer names
    "Aisling Angharad Aoife Bronwen Cara Carys Ciara Ciarán Cormac Deirdre Dermot Eamon Ewan Fergus Finn Gethin Hamish Iain Leda Maeve Mairead Milo Niamh Odhran Orla Rhea Rhiannon Róisín Seamus Siobhán Sorcha Tamsin Zelda".split()
)
# Given names that are words or product names as well; they need a middle initial or a known family name behind them, or a cue.
AMBIGUOUS = frozenset("Art Bill Brook Can Chase Claude Chip Crystal Dawn Destiny Don Drew Faith Frank Grace Grant Guy Hope Hunter Ion Jordan Joy June Lan Lei Li Mark May April Mason Max Melody Min Ming Nelson Norm Parker Pat Pearl Penny Ray Rich Rob Rose Roman Ruby Sandy Said Seo Sierra Sky Soo Star Summer Victor Virginia Georgia Will Holly Hazel Jay Jun Jin Lee Kim Jasmine Iris Ivy Violet Daisy Pascal Ali Amber Regina Austin Logan Madison Sidney Cameron Mercedes Aurora".split())
